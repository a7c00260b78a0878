"""Training of the neural collaborative filtering model.

Mini-batch SGD on the binary cross-entropy, by strata (``operators.strata``):
users and items are cut into B blocks each, and a round trains B cells of
labelled pairs of which no two share a block. Embeddings never meet two tasks
in one round, so they need no averaging; every task starts from the same dense
layers (a few thousand numbers), which are averaged after each round, weighted
by the pairs a task has trained on. B rounds go over all cells: an epoch.

The order of the pairs within a cell and the starting values are rules of
(seed, ids), so a task that runs again gives the same numbers.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.scoring import LATENT_GMF, LATENT_MLP, LAYERS, NCFLayers, score_pairs
from reelspark.operators.strata import blocks_of, cells_of, sides, strata_for, train_round
from reelspark.session import bound_arrow_batches, checkpoint_dir


@dataclass(frozen=True)
class Settings:
    """epochs and batch are the reference's. ``lr`` is the step on the mean
    gradient of a batch. Embeddings see one pair of a batch each, so their mean
    gradient is 1/batch of that pair's; ``embedding_scale`` multiplies their
    step (1: plain SGD; the reference's lr is 0.001, with which two epochs
    leave the starting values almost as they are)."""
    epochs: int = 2
    batch: int = 256
    lr: float = 0.02
    embedding_scale: float = 16384.0
    latent_mlp: int = LATENT_MLP
    latent_gmf: int = LATENT_GMF
    layers: tuple = tuple(LAYERS)
    seed: int = 42


@dataclass
class NCFModel:
    """users (uid, u_mlp, u_gmf), items (mid, i_mlp, i_gmf) and the dense layers."""
    users: DataFrame
    items: DataFrame
    layers: NCFLayers


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((_mixed(x) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53


def starting_vectors(ids: np.ndarray, width: int, salt: int) -> np.ndarray:
    """(ids, width) standard normal numbers, a rule of (salt, id, place)."""
    base = _mixed(ids.astype(np.int64).view(np.uint64) * np.uint64(2) + np.uint64(salt))
    cell = base[:, None] + np.arange(2 * width, dtype=np.uint64)[None, :] * np.uint64(0xD1342543DE82EF95)
    u, v = _uniform(cell[:, :width]), _uniform(cell[:, width:])
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


def starting_layers(s: Settings) -> NCFLayers:
    """Uniform within 1 / sqrt(inputs)."""
    r = np.random.default_rng(s.seed)
    draw = lambda n, *shape: r.uniform(-1, 1, shape) / math.sqrt(n)
    sizes = list(zip(s.layers[:-1], s.layers[1:], strict=True))
    width = s.layers[-1] + s.latent_gmf
    return NCFLayers([draw(i, o, i) for i, o in sizes], [draw(i, o) for i, o in sizes], draw(width, width), float(draw(width, 1)[0]))


def pair_order(uids: np.ndarray, mids: np.ndarray, seed: int, epoch: int) -> np.ndarray:
    """The order in which an epoch takes the pairs of a cell."""
    salt = _mixed(np.array([seed * 1000 + epoch], np.uint64))[0]
    key = _mixed(_mixed(uids.view(np.uint64) ^ salt) + mids.view(np.uint64))
    return np.lexsort((mids, uids, key))


def train_cell(layers: NCFLayers, users: np.ndarray, items: np.ndarray, u: np.ndarray, i: np.ndarray, y: np.ndarray, s: Settings) -> None:
    """SGD over the pairs (rows u of users, i of items, labels y) in order, in
    batches; changes all arrays in place. A row of users or items is [mlp, gmf]."""
    m, ws, bs = s.latent_mlp, layers.weights, layers.biases
    for lo in range(0, len(u), s.batch):
        ub, ib, yb = u[lo:lo + s.batch], i[lo:lo + s.batch], y[lo:lo + s.batch]
        eu, ei = users[ub], items[ib]
        outs = [np.concatenate([eu[:, :m], ei[:, :m]], axis=1)]
        for w, b in zip(ws, bs, strict=True):
            outs.append(np.maximum(outs[-1] @ w.T + b, 0.0))
        v = np.concatenate([outs[-1], eu[:, m:] * ei[:, m:]], axis=1)
        error = (1.0 / (1.0 + np.exp(-(v @ layers.out_w + layers.out_b))) - yb) / len(yb)
        back = error[:, None] * layers.out_w[None, :]
        layers.out_w -= s.lr * (v.T @ error)
        layers.out_b -= s.lr * float(error.sum())
        gate, back = back[:, len(bs[-1]):], back[:, :len(bs[-1])]
        for k in range(len(ws) - 1, -1, -1):
            back = back * (outs[k + 1] > 0)
            below = back @ ws[k]
            ws[k] -= s.lr * (back.T @ outs[k])
            bs[k] -= s.lr * back.sum(axis=0)
            back = below
        step = s.lr * s.embedding_scale
        np.subtract.at(users, ub, step * np.concatenate([back[:, :m], gate * ei[:, m:]], axis=1))
        np.subtract.at(items, ib, step * np.concatenate([back[:, m:], gate * eu[:, m:]], axis=1))


def _flat(layers: NCFLayers) -> np.ndarray:
    return np.concatenate([*(w.ravel() for w in layers.weights), *layers.biases, layers.out_w, [layers.out_b]])


def _layers(flat: np.ndarray, s: Settings) -> NCFLayers:
    at, ws, bs = 0, [], []
    sizes = list(zip(s.layers[:-1], s.layers[1:], strict=True))
    for i, o in sizes:
        ws.append(flat[at:at + i * o].reshape(o, i).copy())
        at += i * o
    for _, o in sizes:
        bs.append(flat[at:at + o].copy())
        at += o
    return NCFLayers(ws, bs, flat[at:-1].copy(), float(flat[-1]))


def _kernel(flat: np.ndarray, s: Settings, epoch: int):
    """Trains one cell from the dense layers ``flat``; returns the layers after it."""
    def run(ids, tables, us, ms, ys, cell) -> bytes:
        layers, order = _layers(flat, s), pair_order(us, ms, s.seed, epoch)
        us, ms, ys = us[order], ms[order], ys[order]
        train_cell(layers, *tables, np.searchsorted(ids[0], us), np.searchsorted(ids[1], ms), ys, s)
        return _flat(layers).tobytes()
    return run


def fit_ncf(train: DataFrame, users: DataFrame, items: DataFrame, s: Settings = Settings(), strata: int | None = None) -> NCFModel:
    """The model after ``s.epochs`` over ``train`` (uid, mid, label 0/1; each
    pair once). users (uid) and items (mid) get an embedding each, also those
    without a pair; pairs whose user or item is not among them are left out.
    """
    spark = train.sparkSession
    bound_arrow_batches(spark)
    checkpoint_dir(spark)
    b = strata or strata_for(train.count(), spark.sparkContext.defaultParallelism)
    width = s.latent_mlp + s.latent_gmf

    def start(keys: DataFrame, key: str, salt: int) -> DataFrame:
        ids = keys.select(F.col(key).cast("bigint").alias("id")).distinct()
        return blocks_of(ids, b, lambda t: starting_vectors(t.column("id").to_numpy(), width, salt))

    ut, it = start(users, "uid", 1 + 2 * s.seed), start(items, "mid", 2 + 2 * s.seed)
    known = (train.select("uid", "mid", "label").join(users.select("uid").distinct(), "uid", "left_semi").join(items.select("mid").distinct(), "mid", "left_semi"))
    cells = cells_of(known.select(F.col("uid").alias("left"), F.col("mid").alias("right"), F.col("label").alias("value")), b)
    flat = _flat(starting_layers(s))
    for epoch in range(s.epochs):
        for shift in range(b):
            done = train_round(ut, it, cells, b, shift, width, _kernel(flat, s, epoch))
            ut, it = sides(done)
            dense = sorted((r["block"], r["n"], r["dense"]) for r in done.where("kind = 0 and n > 0").select("block", "n", "dense").collect())
            if dense:
                flat = sum(n * np.frombuffer(d) for _, n, d in dense) / sum(n for _, n, _ in dense)
    return NCFModel(_unpacked(ut, "uid", "u", s), _unpacked(it, "mid", "i", s), _layers(flat, s))


def _unpacked(blocks: DataFrame, key: str, letter: str, s: Settings) -> DataFrame:
    width, m = s.latent_mlp + s.latent_gmf, s.latent_mlp

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))
        for batch in batches:
            for r in batch.to_pylist():
                ids, v = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists(v[:, :m]), lists(v[:, m:])], names=[key, f"{letter}_mlp", f"{letter}_gmf"])
    return blocks.mapInArrow(run, f"{key} bigint, {letter}_mlp array<double>, {letter}_gmf array<double>")


_written: dict[tuple, tuple[str, np.ndarray]] = {}


def fitted_once(fit, spark, name: str, s: Settings = Settings()) -> NCFModel:
    """The model ``name``, fitted and written below the shared checkpoint folder
    the first time an application asks for it."""
    key = (spark.sparkContext.applicationId, name, s)
    if key not in _written:
        path = f"{checkpoint_dir(spark).rstrip('/')}/ncf-{uuid.uuid4().hex}"
        model = fit(s)
        model.users.write.parquet(f"{path}/users")
        model.items.write.parquet(f"{path}/items")
        _written[key] = path, _flat(model.layers)
    path, flat = _written[key]
    return NCFModel(spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/items"), _layers(flat, s))


def score_model(model: NCFModel, pairs: DataFrame) -> DataFrame:
    """(user_idx, item_idx, score) of the pairs (uid, mid) whose user and item have embeddings."""
    renamed = pairs.select(F.col("uid").alias("user_idx"), F.col("mid").alias("item_idx"))
    return score_pairs(renamed, model.users.withColumnRenamed("uid", "user_idx"), model.items.withColumnRenamed("mid", "item_idx"), model.layers)


def auc(model: NCFModel, test: DataFrame) -> tuple[float, int]:
    """ROC AUC over ``test`` (uid, mid, label), and the number of pairs."""
    scored = (score_model(model, test).withColumnsRenamed({"user_idx": "uid", "item_idx": "mid"})
              .join(test.select("uid", "mid", F.col("label").cast("double").alias("label")), ["uid", "mid"]).checkpoint())
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label").evaluate(scored), scored.count()
