"""Products of vectors of few dimensions by cells of near rows, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from reelspark.operators import als
from reelspark.operators import products as pr


@pytest.mark.parametrize(("k", "floor", "not_self"), [(5, -np.inf, True), (5, 0.4, False), (None, 0.9, True), (3, 0.0, False)])
@pytest.mark.parametrize("dense", [0.0, 1.0])
@pytest.mark.parametrize("kind", ["curve", "noise", "few"])
def test_cells_give_all_products(monkeypatch, k, floor, not_self, kind, dense):
    r = np.random.default_rng(1)
    n = 300
    x = np.linspace(0, 9, n)
    v = np.stack([np.sin(x * (j + 1) + j) + 0.3 for j in range(5)], axis=1) if kind == "curve" else r.normal(size=(n, 5))
    if kind == "few":
        v = np.round(v)  # equal vectors, zero vectors, ties
    monkeypatch.setattr(pr, "NEAR_TILE", 32)
    monkeypatch.setattr(pr, "FIRST", 2)
    monkeypatch.setattr(pr, "BOUNDED", 8)
    monkeypatch.setattr(pr, "MET", 4)
    monkeypatch.setattr(pr, "DENSE", dense)
    monkeypatch.setattr(pr, "STRAIGHT", 64)
    ids = np.arange(n) * 3
    out_l, out_r = ids[r.integers(0, n, 900)], np.sort(ids[r.integers(0, n, 900)])
    block = pr.NearBlock(ids, v, out_l, out_r, k, floor, 9, not_self)
    found = []
    for part in (slice(0, 160), slice(160, n)):  # two offers, as of two tasks' rows
        half = ids[part]
        cut = r.permutation(len(half))
        cells = pr.Cells([(np.sort(half[c]), v[part][np.sort(c)]) for c in (cut[:70], cut[70:])])
        found += list(block.meet(cells))
    s = v @ v.T
    s[out_l // 3, out_r // 3] = -np.inf
    if not_self:
        np.fill_diagonal(s, -np.inf)
    if k is None:
        got = sorted((int(a), int(b)) for f in found for a, b in zip(f[0], f[1]))
        assert got == sorted((3 * int(a), 3 * int(b)) for a, b in zip(*np.nonzero(s > floor)))
        return
    l, p, score = block.rows()
    got = {}
    for a, b, x_ in zip(l.tolist(), p.tolist(), score.tolist()):
        got.setdefault(a // 3, []).append((b // 3, x_))
    for a in range(n):
        want = [b for b in sorted(range(n), key=lambda b: (-round(s[a, b], 9), b)) if s[a, b] > floor][:k]
        assert [b for b, _ in got.get(a, [])] == want


def test_near_rows_meet_few_cells():
    """Before, every pair of rows was multiplied."""
    x = np.linspace(0, 40, 20_000)
    v = np.stack([np.sin(x * (j + 1) / 3 + j) for j in range(6)], axis=1)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, none = np.arange(len(v)), np.empty(0, np.int64)
    block = pr.NearBlock(ids, v, none, none, 10, -np.inf, None, True)
    list(block.meet(pr.Cells([(ids, v)])))
    assert block.met < 0.1 * len(v) ** 2 and block.computed < 100 * len(v)


def test_one_block_a_side_needs_no_product_of_tables(spark):
    side = lambda key: spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], f"{key} bigint, features array<double>")
    top = als.user_recs(als.Factors(side("uid"), side("mid")), 3)
    assert "CartesianProduct" not in top._jdf.queryExecution().toString()
    assert top.count() == 150
