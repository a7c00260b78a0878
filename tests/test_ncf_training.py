"""Stratified training against a plain loop, and what it learns on planted preferences."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import als, scoring
from reelspark.operators.ncf_training import Settings, auc, fit_ncf, pair_order, starting_layers, starting_vectors, strata_for


def _forward(layers, u, i, m):
    h = np.concatenate([u[:m], i[:m]])
    for w, b in zip(layers.weights, layers.biases, strict=True):
        h = np.maximum(w @ h + b, 0)
    return float(np.concatenate([h, u[m:] * i[m:]]) @ layers.out_w + layers.out_b)


def _loss(layers, users, items, batch, m):
    z = np.array([_forward(layers, users[u], items[i], m) for u, i, _ in batch])
    y = np.array([y for _, _, y in batch])
    return float(np.mean(np.logaddexp(0, z) - y * z))


def test_gradients_are_those_of_the_loss():
    """One batch of train_cell against finite differences of the mean cross-entropy."""
    from reelspark.operators.ncf_training import _flat, _layers, train_cell
    s = Settings(batch=8, lr=1.0, embedding_scale=1.0)
    users, items = starting_vectors(np.arange(3), 16, 1), starting_vectors(np.arange(4), 16, 2)
    batch = [(0, 1, 1.0), (0, 2, 0.0), (1, 1, 0.0), (2, 3, 1.0), (2, 0, 1.0)]
    layers = starting_layers(s)
    u2, i2, l2 = users.copy(), items.copy(), _layers(_flat(layers), s)
    train_cell(l2, u2, i2, *(np.array([b[k] for b in batch]) for k in (0, 1)), np.array([b[2] for b in batch]), s)
    eps = 1e-6
    for table, moved in ((users, u2), (items, i2)):
        for at in [(0, 0), (1, 5), (2, 9), (2, 15), (0, 12)]:
            up, down = table.copy(), table.copy()
            up[at] += eps
            down[at] -= eps
            args = (lambda t: (t, items)) if table is users else (lambda t: (users, t))
            slope = (_loss(layers, *args(up), batch, 8) - _loss(layers, *args(down), batch, 8)) / (2 * eps)
            assert table[at] - moved[at] == pytest.approx(slope, abs=1e-7)
    flat, moved = _flat(layers), _flat(l2)
    for k in range(0, len(flat), 97):
        up, down = flat.copy(), flat.copy()
        up[k] += eps
        down[k] -= eps
        slope = (_loss(_layers(up, s), users, items, batch, 8) - _loss(_layers(down, s), users, items, batch, 8)) / (2 * eps)
        assert flat[k] - moved[k] == pytest.approx(slope, abs=1e-7)


def _step(layers, users, items, batch, s):
    """One batch, pair by pair: sums of the gradients first, then the step."""
    m, k = s.latent_mlp, len(layers.weights)
    g_w, g_b = [np.zeros_like(w) for w in layers.weights], [np.zeros_like(b) for b in layers.biases]
    g_out, g_0, g_u, g_i = np.zeros_like(layers.out_w), 0.0, {}, {}
    for u, i, y in batch:
        acts = [np.concatenate([users[u][:m], items[i][:m]])]
        for w, b in zip(layers.weights, layers.biases, strict=True):
            acts.append(np.maximum(w @ acts[-1] + b, 0))
        v = np.concatenate([acts[-1], users[u][m:] * items[i][m:]])
        e = (1 / (1 + np.exp(-(v @ layers.out_w + layers.out_b))) - y) / len(batch)
        g_out, g_0 = g_out + e * v, g_0 + e
        back, gate = (e * layers.out_w)[:len(acts[-1])], (e * layers.out_w)[len(acts[-1]):]
        for j in range(k - 1, -1, -1):
            back = back * (acts[j + 1] > 0)
            g_w[j] += np.outer(back, acts[j])
            g_b[j] += back
            back = layers.weights[j].T @ back
        g_u[u] = g_u.get(u, 0) + np.concatenate([back[:m], gate * items[i][m:]])
        g_i[i] = g_i.get(i, 0) + np.concatenate([back[m:], gate * users[u][m:]])
    for j in range(k):
        layers.weights[j] -= s.lr * g_w[j]
        layers.biases[j] -= s.lr * g_b[j]
    layers.out_w -= s.lr * g_out
    layers.out_b -= s.lr * g_0
    for table, grads in ((users, g_u), (items, g_i)):
        for key, g in grads.items():
            table[key] = table[key] - s.lr * s.embedding_scale * g


@pytest.mark.parametrize("strata", [1, 3])
def test_equals_a_plain_loop(spark, strata):
    r = np.random.default_rng(1)
    s = Settings(epochs=2, batch=16, lr=0.05, embedding_scale=16.0)
    pairs = sorted({(int(u) * 7 - 10, int(m) + 100): float(r.random() < 0.5) for u, m in r.integers(0, 25, (260, 2))}.items())
    rows = [(u, m, y) for (u, m), y in pairs]
    uids, mids = sorted({u for u, _, _ in rows}), sorted({m for _, m, _ in rows})
    frame = spark.createDataFrame([*rows, (999, 100, 1.0), (uids[0], 999, 0.0)], "uid bigint, mid bigint, label double").repartition(3)
    keys = lambda ids, name: spark.createDataFrame([(i,) for i in ids], f"{name} bigint")
    model = fit_ncf(frame, keys([*uids, 5000], "uid"), keys(mids, "mid"), s, strata=strata)
    users = {u: starting_vectors(np.array([u]), 16, 1 + 2 * s.seed)[0] for u in [*uids, 5000]}
    items = {m: starting_vectors(np.array([m]), 16, 2 + 2 * s.seed)[0] for m in mids}
    blocks = {x.id: x.b for x in spark.createDataFrame([(i,) for i in {*uids, *mids}], "id bigint").select(
        "id", F.pmod(F.xxhash64("id"), F.lit(strata)).alias("b")).collect()}
    layers = starting_layers(s)
    for epoch in range(s.epochs):
        for shift in range(strata):
            copies = []
            for b in range(strata):
                mine = [(u, m, y) for u, m, y in rows if blocks[u] == b and blocks[m] == (b + shift) % strata]
                own = scoring.NCFLayers([w.copy() for w in layers.weights], [x.copy() for x in layers.biases], layers.out_w.copy(), layers.out_b)
                if mine:
                    order = pair_order(np.array([u for u, _, _ in mine]), np.array([m for _, m, _ in mine]), s.seed, epoch)
                    mine = [mine[k] for k in order]
                    for lo in range(0, len(mine), s.batch):
                        _step(own, users, items, mine[lo:lo + s.batch], s)
                    copies.append((len(mine), own))
            n = sum(c for c, _ in copies)
            mean = lambda get: sum(c * get(x) for c, x in copies) / n
            layers = scoring.NCFLayers([mean(lambda x, k=k: x.weights[k]) for k in range(3)], [mean(lambda x, k=k: x.biases[k]) for k in range(3)],
                                       mean(lambda x: x.out_w), mean(lambda x: x.out_b))
    for got, want, key in ((model.users.collect(), users, "uid"), (model.items.collect(), items, "mid")):
        assert {x[key] for x in got} == set(want)
        for x in got:
            assert np.abs(np.array([*x[1], *x[2]]) - want[x[key]]).max() < 1e-9
    assert max(np.abs(a - b).max() for a, b in zip(model.layers.weights, layers.weights, strict=True)) < 1e-9
    assert np.abs(model.layers.out_w - layers.out_w).max() < 1e-9 and abs(model.layers.out_b - layers.out_b) < 1e-9


def test_strata():
    assert strata_for(0, 8) == 1 and strata_for(500, 8) == 1 and strata_for(10**5, 8) == 8 and strata_for(10**9, 8) == 62


def test_learns_planted_preferences(spark):
    """Labels from hidden tastes: two epochs come near the click model on ALS factors, which fits such bilinear tastes best."""
    r = np.random.default_rng(5)
    tu, ti = r.normal(size=(400, 3)), r.normal(size=(300, 3))
    rows = [(u, m, int(tu[u] @ ti[m] + 0.3 * r.normal() > 0)) for u in range(400) for m in range(300) if r.random() < 0.5]
    frame = spark.createDataFrame(rows, "uid bigint, mid bigint, label int").withColumn("score", F.col("label") * 4.0 + 0.5)
    train, test = als.holdout_split(frame)
    users, items = spark.range(400).withColumnRenamed("id", "uid"), spark.range(300).withColumnRenamed("id", "mid")
    got, n = auc(fit_ncf(train, users, items, strata=4), test)
    factors = als.fit_als(train, rank=8)
    feats = lambda x: scoring.click_features(x.select("uid", "mid", "label"), factors.users, factors.items)
    other = {x.model: x.auc for x in scoring.click_model(feats(train), feats(test)).collect()}
    assert n == test.count() and got > 0.93 and got > other["mlp"] - 0.03


def test_rounds_broadcast_nothing(spark, monkeypatch):
    """Each round broadcast the smaller tables through the driver, which kept them."""
    from reelspark.operators import strata
    pairs = spark.createDataFrame([(u, m, 1.0) for u in range(20) for m in range(15)], "left bigint, right bigint, value double")
    ids = lambda n: spark.range(n)
    start = lambda t: np.zeros((t.num_rows, 2))
    left, right, cells = strata.blocks_of(ids(20), 3, start), strata.blocks_of(ids(15), 3, start), strata.cells_of(pairs, 3)
    plans = []
    monkeypatch.setattr(type(left), "checkpoint", lambda self, *a, **k: plans.append(self) or self)

    def kernel(ids_, tables, ls, rs, ys, cell):
        tables[0][:] += len(ls)
        return str(cell).encode()
    done = strata.train_round(left, right, cells, 3, 1, 2, kernel)
    assert "Join" not in plans[0]._jdf.queryExecution().executedPlan().toString()
    rows = done.collect()
    assert sorted(r.dense.decode() for r in rows if r.kind == 0) == ["(0, 1)", "(1, 2)", "(2, 0)"]
    assert sorted((r.kind, r.block) for r in rows) == [(k, b) for k in (0, 1) for b in range(3)]
    assert sum(r.n for r in rows) == sum(len(np.frombuffer(c.ls, np.int64)) for c in cells.collect() if (c.rb - c.lb) % 3 == 1)
