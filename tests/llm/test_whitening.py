from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelspark.llm import whitening
from reelspark.llm.whitening import Spectrum, rank_one, secular_roots, whiten


def _orthonormal(n, seed):
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.0, 1e-14, 1e-9, 0.5, 0.5, 0.5 + 1e-12, 1.0, 3.0, 3.0, 1e6]), min_size=1, max_size=12),
       st.lists(st.sampled_from([0.0, 1e-17, 1e-8, 0.3, -0.3, 1.0, -2.0]), min_size=12, max_size=12), st.sampled_from([1e-9, 0.5, 1.0, 1e4]))
def test_rank_one_update(values, z, rho):
    values, z = np.sort(np.array(values)), np.array(z[:len(values)])
    basis = _orthonormal(len(values), len(values))
    got, vectors = rank_one(values, basis, z, rho)
    want = basis @ (np.diag(values) + rho * np.outer(z, z)) @ basis.T
    size = max(1e-300, np.abs(np.linalg.eigvalsh(want)).max())
    assert np.abs(got - np.linalg.eigvalsh(want)).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.abs(vectors @ np.diag(got) @ vectors.T - want).max() <= 1e-13 * size


def test_secular_roots_interlace():
    rng = np.random.default_rng(2)
    for k in (1, 2, 5, 40):
        d, z = np.sort(rng.random(k)) + np.arange(k) * 1e-3, rng.normal(size=k)
        mu, delta = secular_roots(d, z, 0.7)
        assert (mu > d).all() and (mu[:-1] < d[1:]).all() and mu[-1] <= d[-1] + 0.7 * (z @ z)
        assert np.abs(mu - np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(z, z))).max() < 1e-12
        assert np.abs(delta - (d[:, None] - mu)).max() < 1e-12


def test_spectra_of_many_updates_and_merges():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(1500, 12)) * np.array([30, 30, 20, 9, 5, 5, 4, 3, 2, 1, 0, 0]))
    x[:, 10] = x[:, 0] * 2
    parts = []
    for lo, hi in ((0, 1), (1, 700), (700, 1500)):
        s = Spectrum(12)
        for v in x[lo:hi]:
            s.add(v)
        parts.append(s)
    parts[1].merge(parts[0])
    parts[1].merge(parts[2])
    s, scatter = parts[1], np.cov(x.T, bias=True) * len(x)
    assert s.n == 1500 and np.abs(s.mean - x.mean(axis=0)).max() < 1e-11
    assert np.abs(s.basis @ np.diag(s.values) @ s.basis.T - scatter).max() < 1e-10 * scatter.max()
    assert np.abs(s.basis.T @ s.basis - np.eye(12)).max() < 1e-12


def _plain(rows):
    """(n, S, e, vectors, trace, rows) from the definition, in integers as far as they go."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    listed = np.array(sorted({tuple(x) for _, x in good}), dtype=object)
    n, s = len(listed), listed.sum(axis=0)
    away = n * listed - s
    cov = np.array((away.T @ away).tolist(), dtype=np.float64) / float(n) ** 3
    e, q = np.linalg.eigh(cov)
    return n, s, e[::-1], q[:, ::-1], float(np.trace(cov)), good


def _check(rows, got, components=16):
    n, s, e, q, trace, good = _plain(rows)
    k = min(components, len(e), int((e > 1e-13 * trace).sum()))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append(r)
    assert len(got) == k * len(good)
    assert all(r.n == n and r.identity_error < 1e-9 for r in got)
    signs = {}
    for i, x in good:
        away = [n * a - b for a, b in zip(x, s, strict=True)]
        mine = by[i, sum(a * a for a in away)]
        want = np.array([a / n for a in away]) @ q[:, :k] / np.sqrt(e[:k])
        for r in mine:
            w = want[r.component - 1]
            if abs(w) > 1e-6:
                assert signs.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
            assert abs(abs(r.whitened) - abs(w)) < 1e-8 * max(1, abs(w))
            assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5).selectExpr("*", "1 AS x", "2 AS n", "3 AS dim", "'y' AS part", "4 AS component")


def test_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 40)
    rng = np.random.default_rng(7)
    mix = rng.normal(size=(24, 24)) * np.linspace(0.05, 1, 24)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(1200, 24)) @ mix)]
    same = rows[3][1]
    rows += [(5000 + i, same) for i in range(300)] + [(None, rows[5][1]), (7, rows[9][1]), (7, rows[9][1]), (8, None), (9, []), (10, [None] * 24),
                                                      (11, [float("nan")] + [0.0] * 23), (12, [float("inf")] + [0.0] * 23), (13, [0.0] * 24), (14, [-0.0] * 24)]
    _check(rows, whiten(_frame(spark, rows)).collect())


def test_few_components_and_no_variance(spark):
    rng = np.random.default_rng(8)
    flat = [(i, [float(a), float(a), 2.5, float(b)]) for i, (a, b) in enumerate(rng.normal(size=(50, 2)))]
    _check(flat, whiten(_frame(spark, flat)).collect())
    assert {r.component for r in whiten(_frame(spark, flat)).collect()} == {1, 2}
    assert whiten(_frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whiten(_frame(spark, [])).collect() == []
    assert whiten(_frame(spark, [(1, None), (2, [])])).collect() == []


def test_lengths_apart_and_huge_entries(spark):
    rng = np.random.default_rng(9)
    short = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(60, 3)))]
    long = [(100 + i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(80, 5)))]
    got = whiten(_frame(spark, short + long)).collect()
    _check(short, [r for r in got if r.vec_id < 100])
    _check(long, [r for r in got if r.vec_id >= 100])
    huge = whiten(_frame(spark, [*short, (70, [1e38, -1e38, 0.0])])).collect()
    assert {r.n for r in huge} == {61} and any(r.deviation is None for r in huge)


def test_driver_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    _check(rows, whiten(df).collect())
