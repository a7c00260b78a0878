"""Largest inner products between two tables of vectors, over pairs of packed blocks.

Both tables are packed into blocks. A task gets some blocks of the left table
and some of the right (a cartesian product of partitions, which reads each
packed block where it lies, so nothing is shuffled once per partner) and keeps
either the k best partners of each left row or all partners over the floor.

A block pair is screened in single precision, on the leading directions of the
left block's vectors with the lengths of the rests (Cauchy-Schwarz) when these
are few, else on all dimensions. The screen never falls below the product less
its rounding; pairs that pass it are computed again in double precision, and
only these numbers are compared and returned.

Vectors of few dimensions are met by cells instead (``NearBlock``): a task holds
its right blocks in cells of near rows, and tiles of near left rows meet the
cells in the order of a bound of their products, down to the k-th found or the
floor. Cells below it are not multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.topk import top_k_per_group
from reelspark.operators.towers import cell_order
from reelspark.session import bound_arrow_batches

#: Bytes of a block's vectors, and of the right blocks that a task holds.
BLOCK_BYTES, HELD_BYTES = 4 << 20, 64 << 20
#: Left blocks of a task at most, where that leaves tasks enough.
LEFT_BLOCKS = 8
#: Left rows of a tile, pairs computed again at a time, dimensions up to which all are screened, energy outside the leading directions.
TILE_ROWS, CHUNK, WHOLE, REST = 256, 1 << 14, 24, 0.01
#: Share of a tile beyond which pairs that pass on leading directions are screened on all.
MANY = 0.02

#: Right rows of a cell; cells that a tile meets first, that are bounded for each of its rows at once, and that are multiplied at once.
CELL, FIRST, BOUNDED, MET = 16, 32, 1024, 256
#: Rows of a tile of near rows, and pairs of one of its rows beyond which they are screened in double precision.
NEAR_TILE, CROWDED = 256, 8
#: Share of the cells beyond which a tile meets all rows, and rows that it then meets at once.
DENSE, STRAIGHT = 0.3, 2048
#: Centres that rows are dealt around at most, a bounded choice that only costs depend on.
MOST_CENTRES = 512

_LISTS = "l bigint, r bigint, score double"


def block_rows(dim: int, most: int) -> int:
    return max(1, min(most, BLOCK_BYTES // (8 * max(1, dim))))


#: Rows of a block of few dimensions at most.
LOW_BLOCK = 16384


def low_rows(spark, n: int, least: int) -> int:
    """Rows of a block of few dimensions: many, as each left block is sent each right one, but not so many that cores are idle."""
    return max(least, min(LOW_BLOCK, math.ceil(n / (2 * spark.sparkContext.defaultParallelism))))


def pack_vectors(v: np.ndarray) -> bytes:
    """Single precision where that loses nothing; the length tells which."""
    v = np.ascontiguousarray(v, np.float64)
    single = v.astype(np.float32)
    return (single if (single == v).all() else v).tobytes()


def unpack_vectors(data: bytes, rows: int, dim: int) -> np.ndarray:
    kind = np.float64 if len(data) == 8 * rows * dim else np.float32
    return np.frombuffer(data, kind).reshape(rows, dim).astype(np.float64)


_BLOCK = "block int, ids binary, vecs binary"


def _packed(key_: tuple, table: pa.Table) -> pa.Table:
    ids = table.column("id").to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    v = table.column("v").combine_chunks()
    v = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    return pa.table({"block": pa.array([key_[0].as_py()], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "vecs": pa.array([pack_vectors(v[order])], pa.binary())})


def packed_blocks(rows: DataFrame, key: str, vec: str, blocks: int) -> DataFrame:
    """(block, ids, vecs): rows dealt to blocks by a hash of their key, by ascending key."""
    dealt = rows.select(F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(blocks)).cast("int").alias("block"),
                        F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    return dealt.groupBy("block").applyInArrow(_packed, _BLOCK)


def near_rows(v: DataFrame, n: int, block_rows: int) -> tuple[DataFrame, np.ndarray, int]:
    """``v`` (_id, _v; n rows) as (_blk, _id, _v) with blocks of about
    ``block_rows``, the centres and the number of blocks: rows go to the nearest
    centre, the vectors with the least hashes; cells that are too large are split by hash."""
    centres = v.orderBy(F.xxhash64("_id"), "_id").limit(min(MOST_CENTRES, max(1, math.ceil(n / block_rows)))).select("_v").collect()
    c = np.array([r["_v"] for r in centres])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cell = (x @ c.T - 0.5 * (c ** 2).sum(axis=1)).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(cell), batch.column("_v")], names=["_id", "_cell", "_v"])
    dealt = v.mapInArrow(nearest, "_id bigint, _cell int, _v array<double>")
    sizes = dealt.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).orderBy("_cell").collect()  # a row for each centre at most
    split = [math.ceil(r["n"] / block_rows) for r in sizes]
    first = np.cumsum([0, *split])
    cells = v.sparkSession.createDataFrame([(r["_cell"], int(f), m) for r, f, m in zip(sizes, first, split)], "_cell int, _first int, _parts int")
    blocks = (dealt.join(F.broadcast(cells), "_cell")  # MOST_CENTRES rows
              .withColumn("_blk", (F.col("_first") + F.pmod(F.xxhash64("_id"), F.col("_parts"))).cast("int")).select("_blk", "_id", "_v"))
    return blocks, c, max(1, int(first[-1]))


def near_blocks(rows: DataFrame, key: str, vec: str, n: int, block_rows: int) -> tuple[DataFrame, int]:
    """(block, ids, vecs) of near rows, by ascending key, and the number of blocks."""
    v = rows.select(F.col(key).cast("bigint").alias("_id"), F.col(vec).cast("array<double>").alias("_v"))
    blocks, _, number = near_rows(v, n, block_rows)
    return blocks.select(F.col("_blk").alias("block"), F.col("_id").alias("id"), F.col("_v").alias("v")).groupBy("block").applyInArrow(_packed, _BLOCK), number


def packed_pairs(pairs: DataFrame, left: str, right: str, blocks: int) -> DataFrame:
    """(block, out_l, out_r): pairs to leave out, with the left row's block, by ascending right id."""
    def run(key_: tuple, table: pa.Table) -> pa.Table:
        l, r = (table.column(c).to_numpy().astype(np.int64) for c in ("l", "r"))  # noqa: E741
        order = np.argsort(r, kind="stable")
        return pa.table({"block": pa.array([key_[0].as_py()], pa.int32()), "out_l": pa.array([l[order].tobytes()], pa.binary()), "out_r": pa.array([r[order].tobytes()], pa.binary())})
    dealt = pairs.select(F.pmod(F.xxhash64(F.col(left).cast("bigint")), F.lit(blocks)).cast("int").alias("block"),
                         F.col(left).cast("bigint").alias("l"), F.col(right).cast("bigint").alias("r")).where("l is not null and r is not null")
    return dealt.groupBy("block").applyInArrow(run, "block int, out_l binary, out_r binary")


class LeftBlock:
    """A block of left rows, to which blocks of right rows are offered."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, out_l: np.ndarray, out_r: np.ndarray, k: int | None, floor: float, places: int | None, not_self: bool):
        self.ids, self.v, self.k, self.floor, self.places, self.not_self = ids, v, k, floor, places, not_self
        self.single, self.length = v.astype(np.float32), np.linalg.norm(v, axis=1)
        at = np.minimum(np.searchsorted(ids, out_l), max(0, len(ids) - 1))
        known = ids[at] == out_l if len(out_l) else np.zeros(0, bool)
        self.out_row, self.out_r = at[known], out_r[known]
        self.turn = self._turned()
        if self.turn is not None:
            self.head, self.rest = self._split(v, self.length)
        if k is not None:
            self.score, self.partner = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.computed, self.buffer = 0, np.empty(0, np.float32)

    def _turned(self) -> np.ndarray | None:
        """Leading directions of the rows, if few hold nearly all."""
        d = self.v.shape[1]
        if d <= WHOLE:
            return None
        energy, directions = np.linalg.eigh(self.v.T @ self.v)
        share = np.cumsum(energy[::-1]) / max(energy.sum(), 1e-300)
        n = int(np.searchsorted(share, 1 - REST)) + 1
        return np.ascontiguousarray(directions[:, ::-1][:, :n]) if n <= d // 2 else None

    def _split(self, v: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates along the leading directions with the length of the rest, in single precision, and no shorter than it is."""
        head = v @ self.turn
        rest = np.sqrt(np.maximum(length ** 2 - (head ** 2).sum(axis=1), 0) + 1e-12 * length ** 2)
        return np.concatenate([head, rest[:, None]], axis=1).astype(np.float32), rest

    def least(self) -> np.ndarray:
        """Products below this change nothing, for each row."""
        if self.k is None:
            return np.full(len(self.ids), self.floor)
        step = 0.0 if self.places is None else 10.0 ** -self.places
        return np.maximum(self.score[:, -1] - step, self.floor)

    def offer(self, ids: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Right rows by ascending id; gives the pairs over the floor if all are asked for."""
        if not len(ids) or not len(self.ids):
            return
        length, single = np.linalg.norm(v, axis=1), v.astype(np.float32)
        head = None if self.turn is None else self._split(v, length)[0]
        # pairs left out: places of the right ids within the block's pairs
        lo, hi = np.searchsorted(self.out_r, ids), np.searchsorted(self.out_r, ids, side="right")
        n = hi - lo
        col = np.repeat(np.arange(len(ids)), n)
        row = self.out_row[np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(len(col))] if len(col) else np.zeros(0, np.int64)
        if self.not_self:
            same = np.minimum(np.searchsorted(ids, self.ids), len(ids) - 1)
            mine = np.flatnonzero(ids[same] == self.ids)
            row, col = np.concatenate([row, mine]), np.concatenate([col, same[mine]])
        for a in range(0, len(self.ids), TILE_ROWS):
            b = min(a + TILE_ROWS, len(self.ids))
            here = (row >= a) & (row < b)
            yield from self._tile(a, b, ids, v, single, head, float(length.max()), row[here] - a, col[here])

    def _tile(self, a, b, ids, v, single, head, longest, out_row, out_col):
        slack = 4 * (v.shape[1] + 4) * 2.0 ** -24 * self.length[a:b] * longest + 1e-30
        least = self.least()[a:b]
        full = self.k is None or np.isfinite(self.score[a:b, -1]).all()
        r = None
        if head is not None and (full or self.floor > -np.inf):
            s = self._screen(self.head[a:b], head, out_row, out_col)
            r, c = self._over(s, least - slack)
        if r is None or len(r) > MANY * s.size:
            s = self._screen(self.single[a:b], single, out_row, out_col)
            if self.k is not None and not full and s.shape[1] >= self.k:  # the k-th best of this tile is a lower bound
                kth = np.partition(s, s.shape[1] - self.k, axis=1)[:, -self.k].astype(np.float64)
                least = np.maximum(least, kth - 2 * slack - (0.0 if self.places is None else 10.0 ** -self.places))
            r, c = self._over(s, least - slack)
        yield from self._found(a, r, c, ids, v)

    def _found(self, a, r, c, ids, v):
        """Pairs that passed the screen, in double precision."""
        if not len(r):
            return
        self.computed += len(r)
        exact = np.empty(len(r))
        for lo in range(0, len(r), CHUNK):
            part = slice(lo, lo + CHUNK)
            exact[part] = np.einsum("ij,ij->i", self.v[a + r[part]], v[c[part]])
        ok = exact > self.floor
        if self.k is None:
            if ok.any():
                yield self.ids[a + r[ok]], ids[c[ok]], exact[ok]
            return
        self._take(a + r[ok], ids[c[ok]], exact[ok])

    def _screen(self, x: np.ndarray, y: np.ndarray, out_row: np.ndarray, out_col: np.ndarray) -> np.ndarray:
        """x y^T in a buffer that is used again, the pairs left out at minus infinity."""
        if self.buffer.size < len(x) * len(y) or self.buffer.dtype != x.dtype:
            self.buffer = np.empty(len(x) * len(y), x.dtype)
        s = np.matmul(x, y.T, out=self.buffer[:len(x) * len(y)].reshape(len(x), len(y)))
        s[out_row, out_col] = -np.inf
        return s

    @staticmethod
    def _over(s: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places that are not below the bound of their row."""
        bound = np.maximum(np.nextafter(bound.astype(s.dtype), s.dtype.type(-np.inf)), np.finfo(s.dtype).min)
        rows = np.flatnonzero(s.max(axis=1) >= bound)
        at = np.flatnonzero(s[rows] >= bound[rows, None])
        return rows[at // s.shape[1]], at % s.shape[1]

    def _take(self, rows: np.ndarray, partners: np.ndarray, scores: np.ndarray) -> None:
        some = np.unique(rows)
        if not len(some):
            return
        row = np.concatenate([np.repeat(some, self.k), rows])
        partner, score = np.concatenate([self.partner[some].ravel(), partners]), np.concatenate([self.score[some].ravel(), scores])
        shown = score if self.places is None else np.round(score, self.places)
        order = np.lexsort((partner, -shown, row))
        place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        best = order[place < self.k]
        self.partner[some], self.score[some] = partner[best].reshape(-1, self.k), score[best].reshape(-1, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = np.isfinite(self.score)
        return np.broadcast_to(self.ids[:, None], ok.shape)[ok], self.partner[ok], self.score[ok]


def directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which rows have a direction."""
    length = np.linalg.norm(v, axis=1)
    return v / np.where(length > 0, length, 1)[:, None], length > 0


class Cells:
    """The right rows of a task, in cells of near rows: each has a centre with
    the largest distance of its rows from it, and an axis with their largest angle to it and their lengths."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray]]):
        order = [cell_order(v, CELL) for _, v in blocks]
        self.ids, self.v = np.concatenate([i[o] for (i, _), o in zip(blocks, order, strict=True)]), np.concatenate([v[o] for (_, v), o in zip(blocks, order, strict=True)])
        self.single, length = self.v.astype(np.float32), np.linalg.norm(self.v, axis=1)
        ends = np.cumsum([0, *(len(o) for o in order)])
        self.first = np.concatenate([np.arange(lo, hi, CELL) for lo, hi in zip(ends[:-1], ends[1:], strict=True)])
        self.rows = np.diff(np.append(self.first, len(self.ids)))
        each = lambda x: np.repeat(x, self.rows, axis=0)
        self.centre = np.add.reduceat(self.v, self.first) / self.rows[:, None]
        self.radius = np.maximum.reduceat(np.linalg.norm(self.v - each(self.centre), axis=1), self.first) * (1 + 1e-9) + 1e-12
        self.axis, some = directions(self.centre)
        unit, any_ = directions(self.v)
        least = np.minimum.reduceat(np.where(any_ & each(some), (unit * each(self.axis)).sum(axis=1), -1.0), self.first)
        self.cos = np.clip(least - 1e-12, -1.0, 1.0)
        self.sin, self.reach = np.sqrt(1 - self.cos ** 2), np.linalg.norm(self.centre, axis=1) + self.radius
        self.shortest, self.longest_of = np.minimum.reduceat(length, self.first), np.maximum.reduceat(length, self.first)
        self.longest = float(length.max())
        self.cone = [x.astype(np.float32) for x in (self.axis, self.cos, self.sin, self.shortest, self.longest_of)]
        self.by_id = np.argsort(self.ids)
        self.sorted = self.ids[self.by_id]
        self.place = np.full(len(self.ids), -1)

    def tile_bound(self, v: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For each cell: no row of it has a larger product with a row of v, by distances and by angles."""
        middle = v.mean(axis=0)
        apart, size = float(np.linalg.norm(v - middle, axis=1).max()), float(np.linalg.norm(middle))
        # u r <= m c + |m| |r - c| + |u - m| |r|
        bound = self.centre @ middle + size * self.radius + apart * self.reach
        axis, some = directions(middle[None, :])
        unit, any_ = directions(v)
        if some.all() and any_.all():  # the angle between u and r is at least that of the axes less the two widest
            cos = float(np.clip((unit @ axis[0]).min() - 1e-12, -1, 1))
            sin = math.sqrt(1 - cos ** 2)
            x, wide = np.clip(self.axis @ axis[0], -1, 1), self.cos * cos - self.sin * sin
            inside = (x >= wide) | (self.sin * cos + self.cos * sin < 0)  # or the two widest are over a half turn
            x = x * wide + np.sqrt(1 - x * x) * (self.sin * cos + self.cos * sin)
            x[inside] = 1
            bound = np.minimum(bound, np.where(x >= 0, float(length.max()) * self.longest_of, float(length.min()) * self.shortest) * x)
        return bound + 1e-9 * (size + apart) * self.reach + 1e-30

    def reached(self, unit: np.ndarray, length: np.ndarray, least: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Those of some cells whose bound by angles, in single precision, is not below ``least`` for all rows."""
        axis, cos, sin, shortest, longest = (x[some] for x in self.cone)
        x = unit @ axis.T
        inside = x >= cos
        y = np.multiply(x, x)
        np.subtract(1, y, out=y)
        np.sqrt(np.maximum(y, 0, out=y), out=y)
        x *= cos
        x += np.multiply(y, sin, out=y)
        x[inside] = 1
        least = (least / np.maximum(length, 1e-30)).astype(np.float32)
        if (shortest == longest).all():
            x *= longest
        else:
            x *= np.where(x >= 0, longest, shortest)
        return some[(x >= np.nextafter(least, np.float32(-np.inf))[:, None]).any(axis=0)]

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ids are here, and their rows."""
        at = np.minimum(np.searchsorted(self.sorted, ids), len(self.sorted) - 1)
        here = np.flatnonzero(self.sorted[at] == ids)
        return here, self.by_id[at[here]]

    def members(self, cells: np.ndarray) -> np.ndarray:
        n = self.rows[cells]
        return np.repeat(self.first[cells] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())


class NearBlock(LeftBlock):
    """A block of left rows in tiles of near rows, to which cells are offered."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, *rest):
        super().__init__(ids, v, *rest)
        order = cell_order(v, NEAR_TILE)
        turned = np.empty(len(order), np.int64)
        turned[order] = np.arange(len(order))
        self.ids, self.v, self.single, self.length, self.out_row = ids[order], v[order], self.single[order], self.length[order], turned[self.out_row]
        self.unit = directions(self.v)[0].astype(np.float32)
        self.met = 0

    def meet(self, cells: Cells) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Gives the pairs over the floor if all are asked for."""
        if not len(self.ids) or not len(cells.ids):
            return
        out, at = cells.find(self.out_r)
        row = self.out_row[out]
        if self.not_self:
            mine, same = cells.find(self.ids)
            row, at = np.concatenate([row, mine]), np.concatenate([at, same])
        by_row = np.argsort(row, kind="stable")
        row, at = row[by_row], at[by_row]
        starts = np.arange(0, len(self.ids), NEAR_TILE)
        ends = np.searchsorted(row, np.append(starts, len(self.ids)))
        for a, lo, hi in zip(starts, ends[:-1], ends[1:], strict=True):
            yield from self._tile_meets(a, min(a + NEAR_TILE, len(self.ids)), cells, row[lo:hi] - a, at[lo:hi])

    def _tile_meets(self, a: int, b: int, cells: Cells, out_row: np.ndarray, out_at: np.ndarray):
        bound, done = cells.tile_bound(self.v[a:b], self.length[a:b]), np.empty(0, np.int64)
        if self.k is not None and not np.isfinite(self.score[a:b, -1]).all():
            done = np.argpartition(-bound, min(FIRST, len(bound)) - 1)[:FIRST]
            yield from self._meets(a, b, cells, done, out_row, out_at)
        bound[done] = -np.inf
        live = np.flatnonzero(bound >= self.least()[a:b].min()) if len(done) < len(bound) else done[:0]
        live = live[np.isfinite(bound[live])]
        if len(live) > max(BOUNDED, DENSE * len(bound)):  # gathering them would take longer than multiplying
            bound[done] = np.inf
            top = np.maximum.reduceat(bound, np.arange(0, len(bound), STRAIGHT // CELL))
            for some in np.argsort(-top, kind="stable"):
                lo = cells.first[some * (STRAIGHT // CELL)]
                hi = cells.first[(some + 1) * (STRAIGHT // CELL)] if some + 1 < len(top) else len(cells.ids)
                here = (out_at >= lo) & (out_at < hi)
                row, col = out_row[here], out_at[here] - lo
                before = done[(cells.first[done] >= lo) & (cells.first[done] < hi)]
                if len(before):  # the tile has met these
                    old = cells.members(before) - lo
                    row, col = np.concatenate([row, np.repeat(np.arange(b - a), len(old))]), np.concatenate([col, np.tile(old, b - a)])
                self.met += (b - a) * (hi - lo)
                yield from self._tile(a, b, cells.ids[lo:hi], cells.v[lo:hi], cells.single[lo:hi], None, cells.longest, row, col)
            return
        live = live[np.argsort(-bound[live], kind="stable")]
        slack = (self.v.shape[1] + 16) * 2.0 ** -23 * self.length[a:b] * cells.longest + 1e-30
        for lo in range(0, len(live), BOUNDED):
            least = self.least()[a:b]
            some = live[lo:lo + BOUNDED]
            if bound[some[0]] < least.min():
                return
            some = cells.reached(self.unit[a:b], self.length[a:b], least - slack, some)
            for at in range(0, len(some), MET):
                yield from self._meets(a, b, cells, some[at:at + MET], out_row, out_at)

    def _meets(self, a: int, b: int, cells: Cells, some: np.ndarray, out_row: np.ndarray, out_at: np.ndarray):
        at = cells.members(some)
        cells.place[at] = np.arange(len(at))
        col = cells.place[out_at]
        cells.place[at] = -1
        here = col >= 0
        out_row, col = out_row[here], col[here]
        self.met += (b - a) * len(at)
        least, full = self.least()[a:b], self.k is None or np.isfinite(self.score[a:b, -1]).all()
        step = 0.0 if self.places is None else 10.0 ** -self.places
        for mine, other, unit in ((self.single, cells.single, 2.0 ** -24), (self.v, cells.v, 2.0 ** -53)):
            slack = 4 * (self.v.shape[1] + 4) * unit * self.length[a:b] * cells.longest + 1e-30
            s = self._screen(mine[a:b], other[at], out_row, col)
            low = least
            if not full and s.shape[1] >= self.k:  # the k-th best of these cells is a lower bound
                kth = np.partition(s, s.shape[1] - self.k, axis=1)[:, -self.k].astype(np.float64)
                low = np.maximum(least, kth - 2 * slack - step)
            r, c = self._over(s, low - slack)
            if len(r) <= CROWDED * (b - a):
                break
        yield from self._found(a, r, at[c], cells.ids, cells.v)


def _products(dim: int, k: int | None, floor: float, places: int | None, not_self: bool):
    """Rows of a left and a right block, the left block's rows one after the other."""
    batch_of = lambda x: pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["l", "r", "score"])
    low = dim <= WHOLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now, partners = None, None, None
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        cells, of, offered = None, None, []

        def end() -> Iterator[pa.RecordBatch]:
            nonlocal cells, of
            if block is None:
                return
            if low:
                if of != offered:  # the same for each left block of a task
                    cells, of = Cells([held[n] for n in offered]), list(offered)
                yield from map(batch_of, block.meet(cells))
            if k is not None:
                yield batch_of(block.rows())

        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for j in range(batch.num_rows):
                number = column["block"][j].as_py()
                if number != now:
                    yield from end()
                    take = lambda c: np.frombuffer(column[c][j].as_py() or b"", np.int64)  # noqa: E731, B023
                    ids = take("ids")
                    block, now = (NearBlock if low else LeftBlock)(ids, unpack_vectors(column["vecs"][j].as_py(), len(ids), dim), take("out_l"), take("out_r"), k, floor, places, not_self), number
                    partners = column["partners"][j].as_py()
                    partners = None if partners is None else set(partners)
                    offered = []
                other = column["r_block"][j].as_py()
                if partners is not None and other not in partners:
                    continue
                if low and other in held:
                    offered.append(other)
                    continue
                ids = np.frombuffer(column["r_ids"][j].as_py(), np.int64)
                v = unpack_vectors(column["r_vecs"][j].as_py(), len(ids), dim)
                if low:
                    held[other] = ids, v
                    offered.append(other)
                    continue
                for found in block.offer(ids, v):
                    yield batch_of(found)
        yield from end()
    return run


def best_products(left: DataFrame, right: DataFrame, left_blocks: int, right_blocks: int, dim: int, k: int | None, floor: float = -math.inf,
                  places: int | None = None, not_self: bool = False, out: DataFrame | None = None, partners: DataFrame | None = None) -> DataFrame:
    """(l, r, score) of products over ``floor``; with ``k`` also ``rank``, the k
    best of each left row, by the score (rounded to ``places`` if given), ties
    to the smaller r. Exact.

    left and right are (block, ids, vecs) as ``packed_blocks`` makes them, ids
    ascending within a block; ``out`` (block, out_l, out_r) holds pairs to leave
    out and ``partners`` (block, partners) the right blocks a left block needs.
    """
    spark = left.sparkSession
    bound_arrow_batches(spark)
    cores = spark.sparkContext.defaultParallelism
    nothing = F.lit(None).cast("binary")
    sides = left.select("block", "ids", "vecs")
    sides = sides.join(out, "block", "left") if out is not None else sides.withColumns({"out_l": nothing, "out_r": nothing})
    sides = sides.join(partners, "block", "left").withColumn("partners", F.coalesce("partners", F.array().cast("array<int>"))) if partners is not None else sides.withColumn("partners", F.lit(None).cast("array<int>"))
    of_right = max(1, math.ceil(right_blocks / max(1, HELD_BYTES // BLOCK_BYTES)))
    of_left = min(left_blocks, max(math.ceil(4 * cores / of_right), math.ceil(left_blocks / LEFT_BLOCKS)))
    if of_left * of_right < 4 * cores:
        of_right = min(right_blocks, math.ceil(4 * cores / of_left))
    dealt = lambda df, n, c: df.repartitionById(n, F.pmod(F.col(c), F.lit(n)).cast("int"))
    blocks = right.select(F.col("block").alias("r_block"), F.col("ids").alias("r_ids"), F.col("vecs").alias("r_vecs"))
    if left_blocks == right_blocks == 1:
        pairs = sides.join(blocks, F.col("block") == F.col("r_block"))  # both are number 0
    else:
        pairs = dealt(sides, of_left, "block").crossJoin(dealt(blocks, of_right, "r_block").hint("shuffle_replicate_nl"))
    found = pairs.mapInArrow(_products(dim, k, floor, places, not_self), _LISTS)
    if k is None:
        return found
    shown = F.col("score") if places is None else F.round("score", places)
    return top_k_per_group(found, ["l"], [shown.desc(), F.col("r").asc()], k)
