"""JSON scoring requests, rating history in segments, and the lookup index."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import requests, scoring, serving
from reelspark.plans import q_serving


def _model(spark):
    r = np.random.default_rng(1)
    vector = lambda: r.normal(size=8).tolist()
    users = spark.createDataFrame([(u, vector(), vector()) for u in range(4)], "user_idx bigint, u_mlp array<double>, u_gmf array<double>")
    items = spark.createDataFrame([(i, vector(), vector()) for i in range(9)], "item_idx bigint, i_mlp array<double>, i_gmf array<double>")
    return users, items, scoring.init_layers()


def test_requests_of_every_kind(spark):
    users, items, layers = _model(spark)
    pair = lambda u, i: {"user_idx": u, "item_idx": i}
    texts = {1: json.dumps({"test": [pair(0, 3), pair(1, 2), pair(0, 3)]}), 2: json.dumps({"test": []}), 3: "{not json", 4: "{}", 5: None, 6: "",
             7: json.dumps({"test": [pair(0, 1), {"user_idx": 0}, pair(99, 1), pair(2, 99), pair(3, 8)], "more": 1}), 8: json.dumps([1, 2])}
    frame = spark.createDataFrame(list(texts.items()), "id bigint, request string").repartition(3)
    got = {r.id: r.response for r in requests.respond(frame, ["id"], users, items, layers).collect()}
    want = {(r.user_idx, r.item_idx): r.score for r in scoring.score_pairs(users.crossJoin(items).select("user_idx", "item_idx"), users, items, layers).collect()}
    assert json.loads(got[1]) == [[want[0, 3], want[1, 2], want[0, 3]]]
    assert got[2] == "[[]]" and got[3] is None and got[4] is None and got[5] is None and got[6] is None and got[8] is None
    assert json.loads(got[7]) == [[want[0, 1], None, None, None, want[3, 8]]]


def test_lists_of_unequal_length(spark):
    asked = spark.createDataFrame([(1, [10, 11, 12]), (2, [20]), (3, [30, 31]), (4, [40]), (5, [])], "id bigint, mids array<bigint>")
    answers = spark.createDataFrame([(1, "[[0.5, 0.25]]"), (2, "[[0.125, 0.5]]"), (3, "[[null, 0.5]]"), (4, "not json"), (5, "[[0.5]]")], "id bigint, response string")
    got = sorted(map(tuple, requests.read_responses(asked, answers, ["id"]).collect()))
    assert got == [(1, 10, 0.5), (1, 11, 0.25), (2, 20, 0.125), (3, 31, 0.5)]


def test_large_candidate_lists_are_cut(spark):
    candidates = spark.range(2500).select(F.lit(7).alias("uid"), F.col("id").alias("mid"), F.lit(1).alias("user_idx"), (F.col("id") * 2).alias("item_idx"))
    got = sorted(requests.build_requests(candidates, 1000).collect(), key=lambda r: r.part)
    assert [(r.part, len(r.mids), len(json.loads(r.request)["test"])) for r in got] == [(0, 1000, 1000), (1, 1000, 1000), (2, 500, 500)]
    assert json.loads(got[1].request)["test"][3] == {"user_idx": 1, "item_idx": 2006} and got[1].mids[3] == 1003


def test_responses_of_many_requests(spark):
    """Users within a request change from pair to pair, keys are null, pairs are null, places without a pair stay."""
    users, items, layers = _model(spark)
    want = {(r.user_idx, r.item_idx): r.score for r in scoring.score_pairs(users.crossJoin(items).select("user_idx", "item_idx"), users, items, layers).collect()}
    r = np.random.default_rng(5)
    asked = {}
    for key in [(None, 0), (None, 1), *((f"k{i % 40}", i) for i in range(300))]:
        asked[key] = [None if r.random() < 0.05 else (int(r.integers(0, 5)), int(r.integers(0, 10))) for _ in range(int(r.integers(0, 60)))]
    text = lambda pairs: json.dumps({"test": [p and {"user_idx": p[0], "item_idx": p[1]} for p in pairs]})
    frame = spark.createDataFrame([(*k, text(v)) for k, v in asked.items()], "a string, b bigint, request string").repartition(5)
    answers = requests.respond(frame, ["a", "b"], users, items, layers)
    got = {(x.a, x.b): json.loads(x.response)[0] for x in answers.collect()}
    assert got.keys() == asked.keys()
    for key, pairs in asked.items():
        expected = [want.get(p) for p in pairs]
        assert [x is None for x in got[key]] == [x is None for x in expected]
        assert np.allclose([x for x in got[key] if x is not None], [x for x in expected if x is not None], rtol=0, atol=1e-12)
    assert answers._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1  # parsed once


def test_users_are_joined_once_per_request(spark):
    users, items, layers = _model(spark)
    frame = spark.createDataFrame([(i, json.dumps({"test": [{"user_idx": i % 4, "item_idx": j % 9} for j in range(50)]})) for i in range(30)], "id bigint, request string")
    assert requests.parse_requests(frame, ["id"]).count() == 30  # before: one row per pair, 1,500
    assert all(len(json.loads(r.response)[0]) == 50 for r in requests.respond(frame, ["id"], users, items, layers).collect())


def test_requests_of_users_over_several_ranges(spark):
    """Every range ends within a user; the lists are those of the whole order, with the items of their places."""
    rows = [(u, m, u, m * 3) for u, n in ((1, 700), (2, 1), (3, 1200), (4, 26), (5, 333)) for m in range(n)] + [(None, 5, 1, 15), (6, 8, 6, None)]
    candidates = spark.createDataFrame(rows, "uid bigint, mid bigint, user_idx bigint, item_idx bigint").repartition(7)
    got = {(r.uid, r.part): (r.mids, json.loads(r.request)["test"]) for r in requests.build_requests(candidates, 25).collect()}
    want = {}
    for u, m, x, i in sorted(r for r in rows if r[0] is not None):
        mids, pairs = want.setdefault((u, m // 25 if u != 6 else 0), ([], []))
        mids.append(m)
        pairs.append({"user_idx": x} if i is None else {"user_idx": x, "item_idx": i})
    assert got == want
    index = spark.createDataFrame([(u, u) for u in range(1, 7)], "uid bigint, user_idx bigint")
    lists = requests.candidate_lists(candidates.drop("user_idx"), 25).join(index, "uid")
    assert {(r.uid, r.part): (r.mids, json.loads(r.request)["test"]) for r in requests.write_requests(lists).collect()} == want


def test_history_of_a_hot_user(spark):
    rows = [(1, i, 2.5, 1000 - i) for i in range(237)] + [(2, 5, 4.0, 7), (3, 8, 1.0, 5), (3, 6, 1.0, 5)]
    ratings = spark.createDataFrame(rows, "uid bigint, mid bigint, score double, ts bigint").repartition(6)
    got = sorted(serving.user_history(ratings, 50).collect(), key=lambda r: (r.uid, r.segment))
    assert [(r.uid, r.segment, r.n) for r in got] == [(1, 0, 50), (1, 1, 50), (1, 2, 50), (1, 3, 50), (1, 4, 37), (2, 0, 1), (3, 0, 2)]
    told = [x["rating"] for r in got if r.uid == 1 for x in json.loads(r.ratings)]
    assert [(x["timestamp"], x["mid"]) for x in told] == [(1000 - i, i) for i in range(236, -1, -1)]
    assert [x["rating"]["mid"] for x in json.loads(got[-1].ratings)] == [6, 8]


def test_lookup_reads_the_index_without_a_shuffle(spark, sf_dir):
    table = q_serving.indexed_items(spark, sf_dir)
    keys = spark.createDataFrame([(3,), (5,), (3,), (-1,)], "mid bigint")
    joined = serving.lookup_many(keys, table, "mid")
    assert sorted(r.mid for r in joined.collect()) == [3, 5]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan"):]
    assert "SortMergeJoin" in plan and "Bucketed: true" in scan
    # the exchanges are the keys' own: none stands between the index's scan and the join
    lines = plan[:plan.index("FileScan")].splitlines()
    above = lines[-4:]
    assert not any("Exchange" in x for x in above)


def test_point_lookup_reads_one_bucket_and_skips_row_groups(spark, sf_dir):
    table = q_serving.indexed_items(spark, sf_dir)
    mids = sorted(r.mid for r in table.select("mid").collect())
    one = table.where(F.col("mid") == mids[7])
    assert [r.mid for r in one.collect()] == [mids[7]]
    read = lambda df: df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
    per_file = max(r["count"] for r in table.groupBy(F.input_file_name()).count().collect())
    assert read(one) <= per_file < len(mids) / 4  # of eight files one is read
    assert len(one.select(F.input_file_name()).distinct().collect()) == 1
    # a key within a bucket's range that is not there: the bloom filter skips the row group, so the scan puts out no row
    even = spark.range(0, 20_000, 2).withColumnRenamed("id", "mid")
    from reelspark.session import checkpoint_dir
    from reelspark.sources import sinks
    sinks.write_bucketed(even, "even_keys", "mid", 4, f"{checkpoint_dir(spark)}/even-keys")
    missing = spark.table("even_keys").where(F.col("mid") == 10_001)
    assert missing.collect() == []
    assert read(missing) == 0


@pytest.fixture(scope="module", autouse=True)
def _tables(spark):
    yield
    for t in spark.catalog.listTables():
        if t.name.startswith(("items_", "even_keys")):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
