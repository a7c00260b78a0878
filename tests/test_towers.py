"""The exact best-unseen lists against scoring every pair."""

from __future__ import annotations

import numpy as np
import pytest

from reelspark.operators import scoring
from reelspark.operators.towers import BestItems, Tower, best_unseen, cell_order, sigmoid


def _tower(activation, product, gate, seed=1):
    r = np.random.default_rng(seed)
    return Tower(r.normal(size=(12, 4)), r.normal(size=(12, 4)), r.normal(size=(12, 4)) if product else None, r.normal(size=12),
                 ((r.normal(size=(6, 12)), r.normal(size=6)),), r.normal(size=6), r.normal(size=3) if gate else np.zeros(0), 0.1, activation)


def _logit(t, eu, gu, ei, gi):
    """One pair, written out."""
    act = (lambda x: np.maximum(x, 0)) if t.activation == "relu" else (lambda x: 1 / (1 + np.exp(-x)))
    h = t.w_user @ eu + t.w_item @ ei + t.bias
    if t.w_product is not None:
        h = h + t.w_product @ (eu * ei)
    h = act(h)
    for w, b in t.layers:
        h = act(w @ h + b)
    return float(t.out_w @ h + (t.gate_w * gu * gi).sum() + t.out_b)


@pytest.mark.parametrize("activation", ["relu", "sigmoid"])
@pytest.mark.parametrize("product", [False, True])
def test_bounds_hold_and_cells_are_skipped(activation, product):
    t, r = _tower(activation, product, True), np.random.default_rng(2)
    eu, gu = r.normal(size=(20, 4)), r.normal(size=(20, 3))
    centres = r.normal(size=(10, 7)) * 2
    v = centres[r.integers(0, 10, 1000)] + 0.02 * r.normal(size=(1000, 7))
    v = v[cell_order(v, 64)]
    ei, gi = v[:, :4], v[:, 4:]
    logits = t.logits(eu, gu, ei, gi)
    for a, b in ((0, 0), (7, 500), (19, 999)):
        assert logits[a, b] == pytest.approx(_logit(t, eu[a], gu[a], ei[b], gi[b]))
    part = ei @ t.w_item.T
    cells = [tuple(f(x[s:s + 64], axis=0) for x in (part, ei, gi) for f in (np.min, np.max)) for s in range(0, 1000, 64)]
    top = t.bounds(eu, gu, cells)
    for c in range(len(cells)):
        assert (logits[:, 64 * c:64 * c + 64].max(axis=1) <= top[:, c]).all()
    best = BestItems(t, np.arange(20), eu, gu, 5, 6)
    best.offer(np.arange(1000), ei, gi, np.empty(0, np.int64), np.empty(0, np.int64))
    assert best.scored < 0.7 * logits.size  # clustered items: cells whose bound is too low are not scored
    p = np.round(sigmoid(logits), 6)
    for u in range(20):
        want = sorted(range(1000), key=lambda i: (-p[u, i], i))[:5]
        assert best.item[u].tolist() == want and best.score[u].tolist() == p[u, want].tolist()


def test_cell_order_is_a_permutation():
    v = np.random.default_rng(3).normal(size=(777, 3))
    assert sorted(cell_order(v, 64).tolist()) == list(range(777))
    assert cell_order(np.zeros((0, 3))).tolist() == []


@pytest.mark.parametrize(("activation", "product", "gate", "blocks"), [("relu", False, True, (7, 20)), ("sigmoid", True, False, (1000, 16)), ("relu", True, True, (3, 1000))])
def test_lists_equal_all_pairs(spark, activation, product, gate, blocks):
    t, r = _tower(activation, product, gate, 5), np.random.default_rng(6)
    width = 3 if gate else 0
    users = {int(u) * 10 - 30: (r.normal(size=4), r.normal(size=width)) for u in range(25)}
    items = {int(m): (r.normal(size=4), r.normal(size=width)) for m in range(100, 260)}
    for m in range(240, 260):  # equal items: ties
        items[m] = items[150]
    seen = {(u, m) for u in users for m in items if r.random() < 0.2} | {(-30, m) for m in items} | {(-20, m) for m in list(items)[3:]} | {(5, 100), (10, 99)}
    frame = lambda d, key: spark.createDataFrame([(k, e.tolist(), g.tolist()) for k, (e, g) in d.items()], f"{key} bigint, e array<double>, g array<double>")
    had = spark.createDataFrame([*seen, (0, 101), (0, 101)], "uid bigint, mid bigint")
    seen |= {(0, 101)}
    got = best_unseen(frame(users, "uid"), frame(items, "mid"), had, t, 4, user_block=blocks[0], item_block=blocks[1]).collect()
    want = []
    for u, (eu, gu) in users.items():
        scored = sorted((-round(float(sigmoid(np.array(_logit(t, eu, gu, *items[m])))), 6), m) for m in items if (u, m) not in seen)
        want += [(u, rank, m, -s) for rank, (s, m) in enumerate(scored[:4], 1)]
    assert [(x.uid, x.rank, x.mid) for x in sorted(got, key=lambda x: (x.uid, x.rank))] == [w[:3] for w in sorted(want)]
    assert [x.score for x in sorted(got, key=lambda x: (x.uid, x.rank))] == pytest.approx([w[3] for w in sorted(want)], abs=2e-6)


def test_no_users_or_items(spark):
    t = _tower("relu", False, False)
    none = lambda key: spark.createDataFrame([], f"{key} bigint, e array<double>, g array<double>")
    one = spark.createDataFrame([(1, [0.0] * 4, [])], "uid bigint, e array<double>, g array<double>")
    seen = spark.createDataFrame([], "uid bigint, mid bigint")
    assert best_unseen(one, none("mid"), seen, t, 3).collect() == [] == best_unseen(none("uid"), one.withColumnRenamed("uid", "mid"), seen, t, 3).collect()


def test_click_tower_is_the_fitted_model(spark):
    r = np.random.default_rng(8)
    users = spark.createDataFrame([(u, r.normal(size=8).tolist()) for u in range(30)], "uid bigint, features array<double>")
    items = spark.createDataFrame([(m, r.normal(size=8).tolist()) for m in range(40)], "mid bigint, features array<double>")
    pairs = spark.createDataFrame([(u, m, int((u * m) % 3 == 0)) for u in range(30) for m in range(40)], "uid bigint, mid bigint, label int")
    feats = scoring.click_features(pairs, users, items)
    model = scoring.fit_click_model(feats, "mlp", max_iter=5)
    seen = pairs.where("(uid + mid) % 4 = 0")
    got = {(x.uid, x.rank): (x.mid, x.score) for x in scoring.click_lists(model, users, items, seen, 3).collect()}
    best: dict = {}
    for x in model.transform(feats).collect():
        if (x.uid + x.mid) % 4:
            best.setdefault(x.uid, []).append((-round(float(x.probability[1]), 9), x.mid))
    for u, scored in best.items():
        for rank, (s, m) in enumerate(sorted(scored)[:3], 1):
            assert got[u, rank][0] == m and got[u, rank][1] == pytest.approx(-s, abs=1e-8)


def test_items_are_shuffled_to_few_blocks_of_users(spark, monkeypatch):
    """Items went to each 256 users; a block of more users than meet a cell at once gives the same lists."""
    from reelspark.operators import towers
    assert towers.USER_BLOCK >= 8192
    monkeypatch.setattr(towers, "USERS_AT_ONCE", 3)
    t, r = _tower("relu", False, False), np.random.default_rng(9)
    frame = lambda n, key: spark.createDataFrame([(k, r.normal(size=4).tolist(), []) for k in range(n)], f"{key} bigint, e array<double>, g array<double>")
    users, items = frame(20, "uid").checkpoint(), frame(50, "mid").checkpoint()
    seen = spark.createDataFrame([(u, m) for u in range(20) for m in range(50) if r.random() < 0.4], "uid bigint, mid bigint")
    rows = lambda block: sorted(map(tuple, best_unseen(users, items, seen, t, 4, user_block=block, item_block=16).collect()))
    assert rows(1000) == rows(2)


@pytest.mark.parametrize("activation", ["relu", "sigmoid"])
def test_few_pairs_are_scored_in_double(activation):
    """Every pair of a cell was scored in double; now those that single precision, its error allowed for, leaves open."""
    from reelspark.operators.towers import BestItems, Screen, sigmoid
    r = np.random.default_rng(11)
    t = Tower(r.normal(size=(16, 8)), r.normal(size=(16, 8)), r.normal(size=(16, 8)), r.normal(size=16), ((r.normal(size=(8, 16)), r.normal(size=8)),), r.normal(size=8), r.normal(size=3), 0.1, activation)
    eu, gu, ei, gi = r.normal(size=(40, 8)), r.normal(size=(40, 3)), r.normal(size=(700, 8)), r.normal(size=(700, 3))
    single = lambda x: np.ascontiguousarray(x, np.float32)
    sides = (single(eu @ t.w_user.T + t.bias), single(eu), single(gu * t.gate_w), single(ei @ t.w_item.T), single(ei), single(gi))
    exact = t.logits(eu, gu, ei, gi)
    error = Screen(t).error(*sides)
    assert np.abs(Screen(t).logits(*sides) - exact).max() <= error < 0.1
    none = np.empty(0, np.int64)
    best = BestItems(t, np.arange(40), eu, gu, 5, places=9)
    best.offer(np.arange(700), ei, gi, none, none)
    p = np.round(sigmoid(exact), 9)
    assert (best.item == np.lexsort((np.broadcast_to(np.arange(700), p.shape), -p), axis=1)[:, :5]).all()
    assert best.exact < best.scored / 4
