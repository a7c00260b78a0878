from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelspark.llm.ann import nearest_neighbours
from reelspark.llm.lang_id import identify, keep_identified
from reelspark.llm.toxicity import DRIFT, maximal_segments, score_toxicity


def _segments(values):
    """Maximal scoring segments by repeated splitting, from the definition."""
    def go(lo, hi):
        best = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += values[b]
                if total > 1e-9 and (best is None or total > best[0] + 1e-9 or abs(total - best[0]) < 1e-9 and (b + 1 - a) < best[2] - best[1]):
                    best = (total, a, b + 1)
        if best is None:
            return []
        return go(lo, best[1]) + [best] + go(best[2], hi)
    return go(0, len(values))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.0, 0.0, 1.03, 2.11, 0.37]), max_size=14))
def test_all_maximal_segments(scores):
    values = [s if s else -DRIFT for s in scores]
    at = np.flatnonzero(np.array(scores))
    got = maximal_segments(at, np.array(scores)[at]) if len(at) else []
    want = _segments(values)
    assert sum(x[0] for x in got) == pytest.approx(sum(x[0] for x in want))
    assert max((x[0] for x in got), default=0) == pytest.approx(max((x[0] for x in want), default=0))


def _auc(pairs):
    good, bad = [s for s, t in pairs if t], [s for s, t in pairs if not t]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = score_toxicity(docs, labels).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert _auc([(r.score, r.toxic) for r in held]) > 0.95
    right = sum(r.predicted == r.toxic for r in held) / len(held)
    assert right > 0.97


def test_toxicity_odd_rows(spark, make_docs):
    rows = [(i, "you vile scum go" if i % 2 else "a fine day out") for i in range(200)] + [(900, ""), (901, None), (None, "scum"), (900, ""), (902, "scum " * 20000)]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    got = {(r.doc_id, i): r for i, r in enumerate(score_toxicity(docs, labels).collect())}
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got.values()}
    assert by[1].score > by[0].score and by[902].predicted == 1 and by[900].score == by[901].score
    assert all(r.score == 0 for r in score_toxicity(docs, labels.limit(0)).collect())
    assert score_toxicity(docs.limit(0), labels).count() == 0


def test_ann_recall_and_odd_rows(spark):
    rnd = np.random.default_rng(4)
    real = [(i, [float(x) for x in v]) for i, v in enumerate(rnd.normal(size=(3000, 24)).astype(np.float32))]
    same = [float(x) for x in rnd.normal(size=24).astype(np.float32)]
    rows = real + [(5000 + i, same) for i in range(500)] + [(6000, None), (6100, [0.0] * 24), (6200, [float("nan")] * 24), (6300, []), (None, same), (0, real[0][1]),
                                                          (6400, [None] + [1.0] * 23)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS cid", "2 AS shard", "'x' AS score")
    got: dict = {}
    for r in nearest_neighbours(df, shard=700).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {i: v for i, v in rows if i is not None and v and None not in v and not np.isnan(v[0]) and any(v)}
    ids = np.array(sorted(good))
    m = np.array([good[i] for i in ids.tolist()], np.float64)
    assert sorted(got) == [i for i in ids.tolist() if i % 100 == 0]
    hits = 0
    for q, found in got.items():
        found.sort()
        d = np.sqrt(((m - np.array(good[q])) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [s for _, _, s in found] == pytest.approx([float(d[np.searchsorted(ids, v)]) for _, v, _ in found], abs=1e-12)
        hits += len({v for _, v, _ in found} & set(ids[order].tolist()))
        if 5000 <= q < 5500:
            assert [v for _, v, _ in found] == [i for i in range(5000, 5012) if i != q][:10]
    assert hits / (10 * len(got)) > 0.9
    assert nearest_neighbours(df.limit(0)).count() == 0


def test_language_of_the_driver_rows(spark, sf_dir):
    docs, pages = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = identify(docs, pages).collect()
    assert len(got) == docs.count() + pages.count()
    known = {r.doc_id: r.lang for r in docs.collect()}
    right = [r.lang == known[r.doc_id] for r in got if r.kind == "documents"]
    assert sum(right) / len(right) > 0.97
    declared = [r.lang == r.declared for r in got if r.kind == "pages" and r.declared]
    assert sum(declared) / len(declared) > 0.95


def test_language_odd_rows(spark, make_docs):
    rnd = random.Random(2)
    words = ["the", "and", "house", "river", "walks", "under"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(40))) for i in range(30)]
    odd = [(101, ""), (102, None), (103, "12345 !!! 678"), (None, "the house"), (104, "the"), (104, "the"), (105, "the house " * 20000)]
    docs = make_docs(rows + odd)
    kept = keep_identified(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(i) for i in range(30)] + ["None", "104", "104", "105"])
    assert all(r.lang == "und" for r in identify(docs.withColumn("lang", docs["lang"].substr(9, 0)).selectExpr("doc_id", "text", "nullif(lang, '') lang")).collect())
    assert keep_identified(docs.limit(0)).count() == 0
