"""Best inner products and ALS by packed blocks against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest

from reelspark.operators import als
from reelspark.operators import products as pr


@pytest.mark.parametrize(("dim", "k", "floor"), [(6, 4, 0.0), (40, 4, 0.0), (40, None, 1.0), (40, 3, -np.inf), (30, 4, 0.0)])
def test_kernel_equals_all_products(dim, k, floor):
    r = np.random.default_rng(dim)
    few = dim > 30  # few directions hold nearly all: the screen on leading directions is used
    shape = (r.normal(size=(3, dim)) if few else np.eye(dim))
    make = lambda n: r.normal(size=(n, len(shape))) @ shape + (0.01 * r.normal(size=(n, dim)) if few else 0)
    u, v = make(700), make(900)
    v[300:310] = v[5]  # ties
    out_l, out_r = r.integers(0, 700, 3000), np.sort(r.integers(0, 900, 3000))
    block = pr.LeftBlock(np.arange(700), u, out_l, out_r, k, floor, 9, False)
    assert (block.turn is not None) == few
    found = [x for lo in (0, 300, 600) for x in block.offer(np.arange(lo, lo + 300), v[lo:lo + 300])]
    s = u @ v.T
    s[out_l, out_r] = -np.inf
    if k is None:
        got = {(a, b) for x in found for a, b in zip(x[0].tolist(), x[1].tolist())}
        assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(s > floor))}
        assert block.computed < 0.9 * s.size
        return
    for a in range(700):
        want = [b for b in sorted(range(900), key=lambda b: (-round(s[a, b], 9), b)) if s[a, b] > floor][:k]
        got = [b for b, x in zip(block.partner[a].tolist(), block.score[a]) if np.isfinite(x)]
        assert got == want and np.allclose(block.score[a][:len(want)], s[a, want])
    assert block.computed < 0.2 * s.size


def test_blocks_are_not_shuffled_once_per_partner(spark, monkeypatch):
    """Before, each block of users was copied to a shuffle for each block of items."""
    monkeypatch.setattr(als, "USER_BLOCK", 10)
    monkeypatch.setattr(als, "ITEM_BLOCK", 10)
    r = np.random.default_rng(1)
    side = lambda key: spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(100)], f"{key} bigint, features array<double>")
    top = als.user_recs(als.Factors(side("uid"), side("mid")), 3)
    plan = top._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert top.count() <= 300


def test_rows_of_few_and_of_many_ratings_solve_the_same_problem():
    r = np.random.default_rng(2)
    y = r.normal(size=(50, 8)).astype(np.float32)
    degree = [0, 1, 3, 3, 7, 8, 20]
    first = np.append(0, np.cumsum(degree))
    at, s = r.integers(0, 50, first[-1]), r.normal(size=first[-1])
    got = als.solve_rows(y, first[1:], at, s, 0.1)
    for i, n in enumerate(degree[1:]):
        a, b = y[at[first[i + 1]:first[i + 2]]].astype(float), s[first[i + 1]:first[i + 2]]
        assert np.allclose(got[i], np.linalg.solve(a.T @ a + 0.1 * n * np.eye(8), a.T @ b), atol=1e-5)


def test_fit_is_alternating_least_squares(spark):
    r = np.random.default_rng(3)
    rows = sorted({(int(u) * 10 ** 11, int(m) + 5): None for u, m in r.integers(0, 30, (300, 2))})
    scores = {x: float(r.integers(1, 11)) / 2 for x in rows}
    df = spark.createDataFrame([(*x, s) for x, s in scores.items()], "uid long, mid long, score double")
    got = als.fit_als(df, rank=5, max_iter=2, reg=0.1, blocks=3)
    users, items = sorted({u for u, _ in rows}), sorted({m for _, m in rows})
    start = als._starting(np.array(users, np.int64), 5, als.SEED)
    x = {u: start[i].astype(float) for i, u in enumerate(users)}
    fit = lambda mine, y: np.linalg.solve(sum(np.outer(y[k], y[k]) for k, _ in mine) + 0.1 * len(mine) * np.eye(5), sum(s * y[k] for k, s in mine))
    for _ in range(2):
        y = {m: fit([(u, s) for (u, b), s in scores.items() if b == m], x) for m in items}
        x = {u: fit([(m, s) for (b, m), s in scores.items() if b == u], y) for u in users}
    for frame, want, key in ((got.users, x, "uid"), (got.items, y, "mid")):
        have = {r_[key]: r_.features for r_ in frame.collect()}
        assert have.keys() == want.keys() and all(np.allclose(have[k], want[k], atol=1e-4) for k in want)
