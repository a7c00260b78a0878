"""Physical-plan properties the design relies on (checked with explain output)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E

QUERIES = {k: q for k, q in E.queries().items() if k in E.load_all()}
# Heavy model fits are left out; their plans are Spark ML's own.
SKIP = {"als_grid", "als_rmse", "als_similar_items", "als_similar_users", "als_user_recs", "click_model_auc", "click_model_topn",
        "ncf_trained_auc", "ncf_trained_topn", "item2vec_blocks",
        "als_unseen_recs", "als_similar_topn", "similar_users_named", "user_recs_fallback", "item2vec", "item2vec_topk",
        "user_vectors", "item_ml_features", "stream_rerank", "log_filter_stream", "topic_filter"}
TOP_K = ["top_most_rated", "stat_genre_topn", "item_top_ratings", "genre_browse", "recent_k", "embedding_topk"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(spark, sf_dir, monkeypatch):
    """All plans of a query: those its checkpoints cut off, and the last."""
    seen: list[str] = []
    cls = type(spark.range(1))
    original = cls.checkpoint

    def recorded(self, *args, **kwargs):
        seen.append(_plan(self))
        return original(self, *args, **kwargs)

    monkeypatch.setattr(cls, "checkpoint", recorded)

    def build(key):
        seen.append(_plan(QUERIES[key](spark, sf_dir)))
        return seen
    return build


@pytest.mark.parametrize("key", sorted(set(QUERIES) - SKIP))
def test_no_cartesian_products(plans, key):
    for plan in plans(key):
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("key", TOP_K)
def test_top_k_is_partial(spark, sf_dir, key):
    df = QUERIES[key](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString() + _plan(df)
    assert "WindowGroupLimit" in plan or "TakeOrderedAndProject" in plan


def test_scan_reads_only_needed_columns(spark, sf_dir):
    df = QUERIES["stat_most_rated"](spark, sf_dir)
    plan = _plan(df)
    line = next(x for x in plan.splitlines() if "lineitem" in x and "ReadSchema" in x)
    assert "l_extendedprice" not in line and "l_shipdate" not in line
    assert "l_partkey" in line


@pytest.mark.parametrize("key", ["latest_ratings", "rating_histogram", "item_features_scaled"])
def test_ratings_are_hashed_and_scanned_once(spark, sf_dir, key):
    plan = _plan(QUERIES[key](spark, sf_dir))
    assert "partial_max_by" in plan and "SortAggregate" not in plan
    assert sum("lineitem" in x and "FileScan" in x for x in plan.splitlines()) <= (2 if key == "item_features_scaled" else 1)
