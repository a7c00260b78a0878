"""Skip-gram over blocks: pairs, gradients, planted neighbours."""

from __future__ import annotations

import numpy as np
import pytest

from reelspark.operators import item_vectors
from reelspark.operators.item_vectors import Settings, context_pairs, fit_item_vectors, sgns_cell
from reelspark.operators.similarity import dense_cosine_pairs


def test_pairs_equal_brute_force(spark):
    r = np.random.default_rng(2)
    seqs = {u: r.integers(0, 12, r.integers(0, 15)).tolist() for u in range(20)}
    rows = [(u, p, m) for u, s in seqs.items() for p, m in enumerate(s)]
    df = spark.createDataFrame(rows, "uid bigint, pos bigint, mid bigint").repartition(4)
    for least in (1, 12):
        n = {m: sum(x == m for s in seqs.values() for x in s) for m in range(12)}
        want = []
        for s in seqs.values():
            kept = [m for m in s if n[m] >= least]
            want += [(kept[i], kept[j]) for i in range(len(kept)) for j in range(len(kept)) if i != j and abs(i - j) <= 2]
        got = context_pairs(df, Settings(window=2, least=least)).collect()
        assert sorted((x.left, x.right) for x in got) == sorted(want)


def test_one_pair_moves_along_the_gradient():
    r = np.random.default_rng(3)
    items, contexts = r.normal(size=(3, 4)), r.normal(size=(5, 4))
    s = Settings(negatives=2, batch=1)
    i2, c2 = items.copy(), contexts.copy()
    sgns_cell(i2, c2, np.array([0.0, 0, 1, 0, 0]), np.array([1]), np.array([4]), 1.0, s, np.random.default_rng(1))  # both negatives are row 2

    def gain(v, u):
        log = lambda z: -np.logaddexp(0, -z)
        return log(u[4] @ v[1]) + 2 * log(-(u[2] @ v[1]))
    eps = 1e-6
    for k in range(4):
        for table, moved, at in ((items, i2, (1, k)), (contexts, c2, (4, k)), (contexts, c2, (2, k))):
            up, down = table.copy(), table.copy()
            up[at] += eps
            down[at] -= eps
            slope = (gain(up, contexts) - gain(down, contexts) if table is items else gain(items, up) - gain(items, down)) / (2 * eps)
            assert moved[at] - table[at] == pytest.approx(slope, abs=1e-6)
    assert (i2[[0, 2]] == items[[0, 2]]).all() and (c2[[0, 1, 3]] == contexts[[0, 1, 3]]).all()


@pytest.mark.parametrize("strata", [1, 3])
def test_planted_groups_become_neighbours(spark, strata):
    """Users watch items of one group of six at a time: an item's nearest are of its group."""
    r = np.random.default_rng(4)
    rows = [(u, p, int(6 * g + r.integers(0, 6))) for u in range(500) for g in [int(r.integers(0, 8))] for p in range(12)]
    rows += [(900, 0, 777)]  # too rare
    df = spark.createDataFrame(rows, "uid bigint, pos bigint, mid bigint").repartition(4)
    vectors = fit_item_vectors(df, Settings(epochs=4, lr=0.1), strata=strata)
    assert {x.mid for x in vectors.collect()} == set(range(48))
    top = dense_cosine_pairs(vectors, "mid", "vector", k=5, other_col="sim_mid").collect()
    assert sum(x.mid // 6 == x.sim_mid // 6 for x in top) / len(top) > 0.9
    again = fit_item_vectors(df.repartition(7), Settings(epochs=4, lr=0.1), strata=strata)
    assert {x.mid: x.vector for x in again.collect()} == {x.mid: x.vector for x in vectors.collect()}


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, 0, 5), (2, 0, 5)], "uid bigint, pos bigint, mid bigint")
    assert fit_item_vectors(df, Settings(least=1)).collect() == []


def test_fit_keeps_the_vocabulary_off_the_driver(spark, monkeypatch):
    """The library's fit collected it and trained in one task."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.sql import functions as F

    from reelspark.operators import sequences

    def never(*a, **k):
        raise AssertionError("fitted on the driver")
    monkeypatch.setattr(Word2Vec, "fit", never)
    pos = spark.createDataFrame([(u, p, 10 + (u + p) % 4) for u in range(12) for p in range(6)] + [(100 + u, 0, 7) for u in range(5)] + [(200, 0, 8)], "uid bigint, pos bigint, mid bigint")
    got = sequences.item_vectors(sequences.fit_item2vec(sequences.sentences(pos, tokens=3)))
    assert sorted(x.mid for x in got.collect()) == [7, 10, 11, 12, 13]  # 7 has no neighbour, 8 stands once
    assert got.where(F.size("vector") == 10).count() == 5


def test_pairs_are_read_off_runs_without_a_join(spark, monkeypatch):
    """Before, each place was sent to a join once for each place of its window."""
    monkeypatch.setattr(item_vectors, "RUN", 7)
    monkeypatch.setattr(item_vectors, "PAIRS_AT_ONCE", 50)
    seq = [5, 3, 5, 8, 1, 3, 3, 9, 2, 5, 8, 1, 0, 4, 4, 6, 7, 5, 3, 2, 1]
    rows = [(u, p, m + u) for u in range(3) for p, m in enumerate(seq)] + [(None, 0, 3)]
    placed = spark.createDataFrame(rows, "uid bigint, pos bigint, mid bigint")
    got = context_pairs(placed, Settings(window=4, least=1))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    want = [(seq[i] + u, seq[j] + u) for u in range(3) for i in range(len(seq)) for j in range(len(seq)) if i != j and abs(i - j) <= 4]
    assert sorted((x.left, x.right) for x in got.collect()) == sorted(want)
