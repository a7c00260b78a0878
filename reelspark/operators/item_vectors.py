"""Item vectors by skip-gram with negative sampling over partitioned tables.

Items that users like one soon after the other get near vectors. Pairs (item,
item within the window) are read off the sequences, sorted once by user and
position, and packed where they are found; a table of item vectors and one of context vectors are trained by strata
(``operators.strata``): a task holds one block of each and the pairs between
them. Negatives are drawn from the task's context block, by count to the power
of 0.75; over the rounds of an epoch every item meets every block. Nothing of
the vocabulary's size reaches the driver or a closure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.ncf_training import starting_vectors
from reelspark.operators.requests import segments
from reelspark.operators.strata import block_of, blocks_of, sides, strata_for, train_round
from reelspark.session import bound_arrow_batches, checkpoint_dir


#: Places of a user that one task takes, and pairs that it packs at once.
RUN, PAIRS_AT_ONCE = 1 << 12, 1 << 20
#: Pairs whose negatives are drawn at once.
DRAWN = 1 << 14


@dataclass(frozen=True)
class Settings:
    """dim, window, epochs and least are the reference's; lr falls evenly to a hundredth."""
    dim: int = 10
    window: int = 5
    epochs: int = 1
    least: int = 5
    negatives: int = 5
    lr: float = 0.025
    batch: int = 64
    seed: int = 42


def placed_items(positions: DataFrame, s: Settings) -> DataFrame:
    """(uid, pos, mid) of the items that stand ``least`` times or more; the others leave no gap."""
    common = positions.groupBy("mid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= s.least).select("mid")
    kept = positions.join(common, "mid", "left_semi").select("uid", "pos", "mid")
    if s.least > 1:  # places are counted anew, by one distributed sort
        kept = segments(kept, "uid", ["pos"], 1, "_p").select("uid", F.col("_p").alias("pos"), "mid")
    return kept.checkpoint()


def _near_pairs(placed: DataFrame, window: int, blocks: int) -> DataFrame:
    """(lb, rb, ls, rs): pairs of items at most ``window`` places apart in a user's
    sequence, packed by the blocks of both where the rows lie. Rows are dealt and
    sorted once, by user and run of places; a run is preceded by the last places of the one before."""
    rows = placed.where("uid is not null").select("uid", "pos", F.col("mid").cast("bigint").alias("mid"), block_of("mid", blocks).alias("block"), F.floor(F.col("pos") / RUN).alias("run"), F.lit(True).alias("own"))
    before = rows.where(F.col("pos") % RUN >= RUN - window).withColumns({"run": F.col("run") + 1, "own": F.lit(False)})
    dealt = rows.unionByName(before).repartition("uid", "run").sortWithinPartitions("uid", "run", "pos")

    def packed(found: list) -> pa.RecordBatch:
        left, right, lb, rb = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(lb.astype(np.int64) * blocks + rb, kind="stable")
        left, right, lb, rb = left[order], right[order], lb[order], rb[order]
        heads = np.flatnonzero(np.append(True, (lb[1:] != lb[:-1]) | (rb[1:] != rb[:-1])))
        ends = pa.py_buffer((np.append(heads, len(lb)) * 8).astype(np.int32))
        binary = lambda x: pa.Array.from_buffers(pa.binary(), len(heads), [None, ends, pa.py_buffer(x)])
        return pa.RecordBatch.from_arrays([pa.array(lb[heads]), pa.array(rb[heads]), binary(left), binary(right)], names=["lb", "rb", "ls", "rs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found, n = None, [], 0
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "run", "pos", "mid", "block", "own")]
            new = 0 if last is None else len(last[0])
            rows = rows if last is None else [np.concatenate(x) for x in zip(last, rows, strict=True)]
            uid, part, pos, mid, block, own = rows
            for k in range(1, window + 1):
                at = np.arange(max(k, new), len(uid))
                at = at[(uid[at] == uid[at - k]) & (part[at] == part[at - k]) & (pos[at] - pos[at - k] <= window) & own[at]]
                if len(at):
                    found += [(mid[at], mid[at - k], block[at], block[at - k]), (mid[at - k], mid[at], block[at - k], block[at])]
                    n += 2 * len(at)
            last = [x[-window:] for x in rows]
            if n >= PAIRS_AT_ONCE:
                yield packed(found)
                found, n = [], 0
        if found:
            yield packed(found)
    return dealt.mapInArrow(run, "lb int, rb int, ls binary, rs binary")


def context_pairs(positions: DataFrame, s: Settings) -> DataFrame:
    """(left, right, value): every item (uid, pos, mid) with the items at most
    ``window`` places from it in its user's sequence; value is 1. Items that
    stand fewer than ``least`` times take no part, and leave no gap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                left = np.frombuffer(r["ls"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(np.frombuffer(r["rs"], np.int64)), pa.array(np.ones(len(left)))], names=["left", "right", "value"])
    return _near_pairs(placed_items(positions, s), s.window, 1).mapInArrow(run, "left bigint, right bigint, value double")


def _joined(key: tuple, table: pa.Table) -> pa.Table:
    column = lambda c: pa.array([b"".join(table.column(c).to_pylist())], pa.binary())
    return pa.table({"lb": pa.array([key[0].as_py()], pa.int32()), "rb": pa.array([key[1].as_py()], pa.int32()), "ls": column("ls"), "rs": column("rs"), "ys": pa.array([b""], pa.binary())})


def _lefts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pairs of a cell each of its left items has."""
    for batch in batches:
        for r in batch.to_pylist():
            ids, n = np.unique(np.frombuffer(r["ls"], np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])


def sgns_cell(items: np.ndarray, contexts: np.ndarray, weights: np.ndarray, c: np.ndarray, x: np.ndarray, lr: float, s: Settings, rng: np.random.Generator) -> None:
    """SGD over pairs (rows c of items, x of contexts), with negatives drawn by
    ``weights`` from the rows of contexts; changes both in place."""
    ends, dim = np.cumsum(weights), np.arange(items.shape[1])
    flat_items, flat_contexts = items.reshape(-1, copy=False), contexts.reshape(-1, copy=False)  # views: sums at single places are much faster than at rows
    step = max(1, DRAWN // s.batch) * s.batch
    for start in range(0, len(c), step):
        cs, xs = c[start:start + step], x[start:start + step]
        drawn = np.searchsorted(ends, rng.random((len(cs), s.negatives)) * ends[-1], side="right")
        rows = np.concatenate([xs[:, None], np.minimum(drawn, len(ends) - 1)], axis=1)
        told = np.concatenate([np.ones((len(xs), 1)), rows[:, 1:] != xs[:, None]], axis=1)  # a negative that is the context itself tells nothing
        label = np.zeros(s.negatives + 1)
        label[0] = 1.0
        at_items, at_contexts = cs[:, None] * len(dim) + dim, rows[:, :, None] * len(dim) + dim
        for lo in range(0, len(cs), s.batch):
            part = slice(lo, lo + s.batch)
            u, v = contexts[rows[part]], items[cs[part]]
            miss = label - 1.0 / (1.0 + np.exp(-np.einsum("bkd,bd->bk", u, v)))
            miss *= told[part]
            np.add.at(flat_items, at_items[part].ravel(), (lr * np.einsum("bk,bkd->bd", miss, u)).ravel())
            np.add.at(flat_contexts, at_contexts[part].ravel(), (lr * (miss[:, :, None] * v[:, None, :])).ravel())


def _kernel(s: Settings, epoch: int, lr: float):
    def run(ids, tables, ls, rs, ys, cell) -> bytes:
        rng = np.random.default_rng([s.seed, epoch, *cell])
        order = np.lexsort((rs, ls))
        order = order[rng.permutation(len(order))]
        contexts = tables[1][:, :-1].copy()  # the last column holds the weight
        items = tables[0][:, :-1].copy()
        sgns_cell(items, contexts, tables[1][:, -1], np.searchsorted(ids[0], ls[order]), np.searchsorted(ids[1], rs[order]), lr, s, rng)
        tables[0][:, :-1], tables[1][:, :-1] = items, contexts
        return b""
    return run


def starting_items(s: Settings):
    """(mid, vector) of items as a fit starts them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = 0.5 / s.dim * starting_vectors(batch.column("mid").to_numpy(), s.dim, s.seed)
            yield pa.RecordBatch.from_arrays([batch.column("mid"), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * s.dim), pa.array(v.ravel()))], names=["mid", "vector"])
    return run


def fit_item_vectors(positions: DataFrame, s: Settings = Settings(), strata: int | None = None) -> DataFrame:
    """(mid, vector) of every item that stands at least ``least`` times in the
    sequences (uid, pos, mid) and has a neighbour."""
    spark = positions.sparkSession
    bound_arrow_batches(spark)
    checkpoint_dir(spark)
    placed = placed_items(positions, s)
    lengths = placed.where("uid is not null").groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    n_pairs = lengths.agg(*[F.sum(F.greatest(F.col("n") - k, F.lit(0))).alias(f"k{k}") for k in range(1, s.window + 1)]).first()
    b = strata or strata_for(2 * sum(x or 0 for x in n_pairs), spark.sparkContext.defaultParallelism)
    cells = _near_pairs(placed, s.window, b).groupBy("lb", "rb").applyInArrow(_joined, "lb int, rb int, ls binary, rs binary, ys binary").checkpoint()
    counts = cells.mapInArrow(_lefts, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))

    def start(salt: int, spread: float):
        def run(table: pa.Table) -> np.ndarray:
            n = table.column("n").to_numpy().astype(np.float64)
            return np.concatenate([spread * starting_vectors(table.column("id").to_numpy(), s.dim, salt), (n ** 0.75)[:, None]], axis=1)
        return run

    items, contexts = blocks_of(counts, b, start(s.seed, 0.5 / s.dim)), blocks_of(counts, b, start(s.seed + 1, 0.0))
    for epoch in range(s.epochs):
        for shift in range(b):
            done_share = (epoch * b + shift) / (s.epochs * b)
            items, contexts = sides(train_round(items, contexts, cells, b, shift, s.dim + 1, _kernel(s, epoch, s.lr * max(0.01, 1 - done_share))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, v = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, s.dim + 1)[:, :-1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * s.dim), pa.array(np.ascontiguousarray(v).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["mid", "vector"])
    return items.mapInArrow(run, "mid bigint, vector array<double>")
