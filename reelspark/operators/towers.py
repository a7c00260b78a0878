"""Exact best unseen items per user under a scoring network.

A ``Tower`` scores a pair from its user's and item's vectors. Its first layer is
linear in the user, the item and their product, so the user's and the item's
part are computed once and only added per pair.

``best_unseen`` scores every user against every item the user has not seen.
Users and items are packed into blocks; a task takes one block of users and
lets the blocks of items pass by, keeping k items per user, so it holds one
block of each whatever the tables' sizes. Items are shuffled once per block of
users, so these are large; a few users at a time meet a cell. Within a block items lie in cells of
similar vectors. Bounds of the vectors in a cell, carried through the layers
by interval arithmetic, bound the score of all its items at once; users whose
k-th score is above the bound skip the cell. The pairs of the others are first
scored in single precision; only where that score, its rounding allowed for,
reaches the k-th is it computed in double. Nothing is left out otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.topk import top_k_per_group
from reelspark.session import bound_arrow_batches

USER_BLOCK = 8192
#: Users of a block that meet a cell of items at once.
USERS_AT_ONCE = 256
ITEM_BLOCK = 4096
CELL = 64
#: Users that are screened against a cell at once.
SCREENED = 32
#: Decimal places within which scores count as tied (the smaller item id wins).
PLACES = 6

_ROWS = "ub int, lane int, ib int, kind int, ids binary, e binary, g binary, seen_u array<bigint>, seen_m array<bigint>"


@dataclass(frozen=True)
class Tower:
    """sigmoid(out_w . h + gate_w . (g_u * g_i) + out_b) with h the last of the
    layers act(W h + b); the first is act(w_user e_u + w_item e_i + w_product (e_u * e_i) + bias)."""
    w_user: np.ndarray
    w_item: np.ndarray
    w_product: np.ndarray | None
    bias: np.ndarray
    layers: tuple
    out_w: np.ndarray
    gate_w: np.ndarray
    out_b: float
    activation: str = "relu"

    def _act(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x, 0.0, out=x) if self.activation == "relu" else sigmoid(x)

    def logits(self, eu: np.ndarray, gu: np.ndarray, ei: np.ndarray, gi: np.ndarray) -> np.ndarray:
        """(users, items) scores before the last sigmoid."""
        h = (eu @ self.w_user.T + self.bias)[:, None, :] + (ei @ self.w_item.T)[None, :, :]
        if self.w_product is not None:
            h += (eu[:, None, :] * ei[None, :, :]) @ self.w_product.T
        h = self._act(h.reshape(-1, h.shape[2]))
        for w, b in self.layers:
            h = h @ w.T
            h += b
            h = self._act(h)
        return (h @ self.out_w).reshape(len(eu), len(ei)) + (gu * self.gate_w) @ gi.T + self.out_b

    def pair_logits(self, eu: np.ndarray, gu: np.ndarray, ei: np.ndarray, gi: np.ndarray) -> np.ndarray:
        """Scores before the last sigmoid of aligned rows."""
        h = eu @ self.w_user.T + self.bias + ei @ self.w_item.T
        if self.w_product is not None:
            h += (eu * ei) @ self.w_product.T
        h = self._act(h)
        for w, b in self.layers:
            h = self._act(h @ w.T + b)
        return h @ self.out_w + ((gu * self.gate_w) * gi).sum(axis=1) + self.out_b

    def bounds(self, eu: np.ndarray, gu: np.ndarray, cells: list[tuple]) -> np.ndarray:
        """(users, cells): no item of the cell has a larger logit. A cell is the least and largest of its items' first-layer parts, e and g."""
        own = eu @ self.w_user.T + self.bias
        out = np.empty((len(eu), len(cells)))
        for c, (b_lo, b_hi, e_lo, e_hi, g_lo, g_hi) in enumerate(cells):
            lo, hi = own + b_lo, own + b_hi
            if self.w_product is not None:
                p_lo, p_hi = _between(self.w_product, np.minimum(eu * e_lo, eu * e_hi), np.maximum(eu * e_lo, eu * e_hi))
                lo, hi = lo + p_lo, hi + p_hi
            lo, hi = self._act(lo), self._act(hi)
            for w, b in self.layers:
                lo, hi = _between(w, lo, hi)
                lo, hi = self._act(lo + b), self._act(hi + b)
            top = _between(self.out_w[None, :], lo, hi)[1][:, 0]
            gate = gu * self.gate_w
            out[:, c] = top + np.maximum(gate * g_lo, gate * g_hi).sum(axis=1) + self.out_b
        return out + 1e-9 * (1 + np.abs(out))


class Screen:
    """A tower's logits in single precision, and how far they can be from those in double."""

    def __init__(self, tower: Tower):
        single = lambda x: np.ascontiguousarray(x, np.float32)
        self.tower = tower
        self.w_product = None if tower.w_product is None else single(tower.w_product.T)
        self.layers = [(single(w.T), single(b)) for w, b in tower.layers]
        self.out_w = single(tower.out_w)

    def _act(self, x: np.ndarray) -> np.ndarray:
        if self.tower.activation == "relu":
            return np.maximum(x, np.float32(0), out=x)
        np.negative(x, out=x)
        with np.errstate(over="ignore"):  # exp of it is infinite, the sigmoid 0
            np.exp(x, out=x)
        x += np.float32(1)
        return np.reciprocal(x, out=x)

    def logits(self, own: np.ndarray, eu: np.ndarray, gate: np.ndarray, part: np.ndarray, ei: np.ndarray, gi: np.ndarray) -> np.ndarray:
        """(users, items) logits; own and part are the users' and items' first-layer parts, all arrays single."""
        out = np.empty((len(own), len(part)), np.float32)
        for lo in range(0, len(own), SCREENED):  # few enough to stay in the processor's cache
            some = slice(lo, lo + SCREENED)
            h = own[some, None, :] + part[None, :, :]
            if self.w_product is not None:
                h += (eu[some, None, :] * ei[None, :, :]) @ self.w_product
            h = self._act(h.reshape(-1, h.shape[2]))
            for w, b in self.layers:
                h = h @ w
                h += b
                h = self._act(h)
            out[some] = (h @ self.out_w).reshape(out[some].shape)
        return out + gate @ gi.T + np.float32(self.tower.out_b)

    def error(self, own: np.ndarray, eu: np.ndarray, gate: np.ndarray, part: np.ndarray, ei: np.ndarray, gi: np.ndarray) -> float:
        """Largest difference from double for any of these users and items: each sum of n
        terms is off by 2 (n + 8) roundings of its terms' sizes, each layer passes on the errors below it."""
        largest = lambda x: np.abs(x).max(axis=0, initial=0.0).astype(np.float64)
        off = lambda n: 2 * (n + 8) * 2.0 ** -24
        t, flat = self.tower, 1.0 if self.tower.activation == "relu" else 0.25
        size = largest(own) + largest(part)
        if t.w_product is not None:
            size = size + np.abs(t.w_product) @ (largest(eu) * largest(ei))
        err = off(eu.shape[1]) * size
        for w, b in t.layers:
            err, size = self._passed(flat, err, size)
            err = np.abs(w) @ err
            size = np.abs(w) @ size + np.abs(b)
            err = err + off(w.shape[1]) * size
        err, size = self._passed(flat, err, size)
        gates = float(largest(gate) @ largest(gi)) if gate.shape[1] else 0.0
        total = float(np.abs(t.out_w) @ size) + gates + abs(t.out_b)
        return float(np.abs(t.out_w) @ err) + off(len(t.out_w) + gate.shape[1]) * total

    def _passed(self, flat: float, err: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Error and size after an activation, whose own rounding is within 16 units."""
        size = size if self.tower.activation == "relu" else np.ones_like(size)
        return flat * err + 16 * 2.0 ** -24 * size, size


def least_logit(score: np.ndarray, places: int) -> np.ndarray:
    """No smaller logit has a sigmoid that rounds to ``score`` or more."""
    q = np.clip(score - 0.6 * 10.0 ** -places, 0.0, 1.0)
    with np.errstate(divide="ignore"):
        return np.where(q > 0, np.log(q) - np.log1p(-q) - 1e-6, -np.inf)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


def _between(w: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest of w x for lo <= x <= hi."""
    up, down = np.maximum(w, 0).T, np.minimum(w, 0).T
    return lo @ up + hi @ down, hi @ up + lo @ down


def cell_order(vectors: np.ndarray, size: int = CELL) -> np.ndarray:
    """Row numbers such that consecutive runs of ``size`` rows are near each other: halves at the median of the widest dimension."""
    todo, out = [np.arange(len(vectors))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size or vectors.shape[1] == 0:
            out.append(rows)
            continue
        spread = vectors[rows].max(axis=0) - vectors[rows].min(axis=0)
        rows = rows[np.argsort(vectors[rows, int(spread.argmax())], kind="stable")]
        half = -(-len(rows) // (2 * size)) * size  # whole cells on the left
        todo += [rows[half:], rows[:half]]
    return np.concatenate(out) if out else np.empty(0, np.int64)


class BestItems:
    """The k best items of each user of a block, as blocks of items are offered.
    ``scored`` counts the pairs whose score was computed, ``exact`` those in double precision."""

    def __init__(self, tower: Tower, ids: np.ndarray, e: np.ndarray, g: np.ndarray, k: int, places: int = PLACES):
        order = np.argsort(ids)
        self.tower, self.ids, self.e, self.g, self.k, self.places = tower, ids[order], e[order], g[order], k, places
        self.score = np.full((len(ids), k), -np.inf)
        self.item = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.scored = self.exact = 0
        single = lambda x: np.ascontiguousarray(x, np.float32)
        self.screen, self.single = Screen(tower), (single(self.e @ tower.w_user.T + tower.bias), single(self.e), single(self.g * tower.gate_w))

    def offer(self, items: np.ndarray, e: np.ndarray, g: np.ndarray, seen_u: np.ndarray, seen_m: np.ndarray) -> None:
        """Items in cell order; (seen_u, seen_m) are pairs to leave out."""
        seen = np.zeros((len(self.ids), len(items)), bool)
        if len(seen_u):
            at = np.argsort(items)
            seen[np.searchsorted(self.ids, seen_u), at[np.searchsorted(items[at], seen_m)]] = True
        part = e @ self.tower.w_item.T
        singles = tuple(np.ascontiguousarray(x, np.float32) for x in (part, e, g))
        error = self.screen.error(*self.single, *singles)
        spans = [slice(lo, lo + CELL) for lo in range(0, len(items), CELL)]
        cells = [tuple(f(x[s], axis=0) for x in (part, e, g) for f in (np.min, np.max)) for s in spans]
        top = np.round(sigmoid(self.tower.bounds(self.e, self.g, cells)) + 1e-12, self.places)
        for c in np.argsort(-top.mean(axis=0), kind="stable"):
            some = np.flatnonzero(top[:, c] >= self.score[:, -1])
            if len(some):
                self._take(some, spans[c], items, e, g, seen, singles, error)

    def _take(self, some: np.ndarray, span: slice, items: np.ndarray, e: np.ndarray, g: np.ndarray, seen: np.ndarray, singles: tuple, error: float) -> None:
        z = self.screen.logits(*(x[some] for x in self.single), *(x[span] for x in singles)).astype(np.float64)
        self.scored += z.size
        z[seen[some, span]] = -np.inf
        need = self.score[some, -1]
        if z.shape[1] > self.k:  # the k best of the cell's items are no worse than they seem, less the error
            kth = np.partition(z, z.shape[1] - self.k, axis=1)[:, z.shape[1] - self.k] - error
            need = np.maximum(need, np.where(np.isfinite(kth), np.round(sigmoid(kth) - 1e-12, self.places), -np.inf))
        row, col = np.nonzero((z + error >= least_logit(need, self.places)[:, None]) & np.isfinite(z))
        self.exact += len(row)
        p = np.full(z.shape, -np.inf)
        at, to = some[row], span.start + col
        p[row, col] = np.round(sigmoid(self.tower.pair_logits(self.e[at], self.g[at], e[to], g[to])), self.places)
        better = (p >= self.score[some, -1:]).any(axis=1)
        some, p = some[better], p[better]
        item = np.concatenate([self.item[some], np.broadcast_to(items[span], p.shape)], axis=1)
        score = np.concatenate([self.score[some], p], axis=1)
        by_id = np.argsort(item, axis=1, kind="stable")
        score, item = np.take_along_axis(score, by_id, axis=1), np.take_along_axis(item, by_id, axis=1)
        best = np.argsort(-score, axis=1, kind="stable")[:, :self.k]
        self.score[some], self.item[some] = np.take_along_axis(score, best, axis=1), np.take_along_axis(item, best, axis=1)

    def rows(self) -> pa.RecordBatch:
        ok = np.isfinite(self.score)
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(self.ids[:, None], ok.shape)[ok]), pa.array(self.item[ok]), pa.array(self.score[ok])],
                                          names=["uid", "mid", "score"])


def _floats(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(rows, -1) if data else np.zeros((rows, 0))


def _pack(ordered: bool):
    def run(table: pa.Table) -> pa.Table:
        e, g = (np.array(table.column(c).to_pylist(), np.float64).reshape(table.num_rows, -1) for c in ("e", "g"))
        ids = table.column("id").to_numpy().astype(np.int64)
        at = np.argsort(ids)
        at = at[cell_order(np.concatenate([e[at], g[at]], axis=1))] if ordered else at
        return pa.table({"block": table.column("block").slice(0, 1), **{n: pa.array([np.ascontiguousarray(x[at]).tobytes()], pa.binary()) for n, x in (("ids", ids), ("e", e), ("g", g))}})
    return run


def _block(key: str, blocks: int):
    return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(blocks)).cast("int")


def _packed(vectors: DataFrame, key: str, blocks: int, ordered: bool) -> DataFrame:
    return (vectors.select(F.col(key).cast("bigint").alias("id"), "e", "g", _block(key, blocks).alias("block")).groupBy("block")
            .applyInArrow(_pack(ordered), "block int, ids binary, e binary, g binary"))


def _stream(tower: Tower, k: int, places: int):
    """Rows sorted by (ub, lane, ib, kind): users of a block, then per block of items the pairs seen and the items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key, none = [], None, np.empty(0, np.int64)
        seen = (none, none)
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] > 0 and key != (r["ub"], r["lane"]):
                    continue  # no user hashes to this block
                if r["kind"] == 1:
                    seen = (np.array(r["seen_u"], np.int64), np.array(r["seen_m"], np.int64))
                    continue
                ids = np.frombuffer(r["ids"], np.int64)
                e, g = _floats(r["e"], len(ids)), _floats(r["g"], len(ids))
                if r["kind"] == 0:
                    for part in best:
                        yield part.rows()
                    order, key = np.argsort(ids), (r["ub"], r["lane"])
                    best = [BestItems(tower, ids[at], e[at], g[at], k, places) for at in (order[lo:lo + USERS_AT_ONCE] for lo in range(0, len(ids), USERS_AT_ONCE))]
                else:
                    whose = np.searchsorted([part.ids[0] for part in best], seen[0], side="right") - 1
                    by_part = np.argsort(whose, kind="stable")
                    ends = np.searchsorted(whose[by_part], np.arange(len(best) + 1))
                    for part, lo, hi in zip(best, ends[:-1], ends[1:], strict=True):
                        part.offer(ids, e, g, seen[0][by_part[lo:hi]], seen[1][by_part[lo:hi]])
                seen = (none, none)
        for part in best:
            yield part.rows()
    return run


def best_unseen(users: DataFrame, items: DataFrame, seen: DataFrame, tower: Tower, k: int, places: int = PLACES,
                user_block: int = USER_BLOCK, item_block: int = ITEM_BLOCK) -> DataFrame:
    """``uid, mid, score, rank``: each user's k best of all items not in
    ``seen`` (uid, mid), by the score rounded to ``places``, ties to the smaller
    mid. ``users`` is (uid, e, g), ``items`` (mid, e, g) with distinct keys and
    arrays of doubles; pairs in ``seen`` with a user or item that is not in
    them count for nothing. A user who has seen everything has no row.
    """
    spark = users.sparkSession
    bound_arrow_batches(spark)
    n_users, n_items = users.count(), items.count()
    # blocks are smaller where there would be fewer than tasks
    user_block = min(user_block, max(USERS_AT_ONCE, math.ceil(n_users / (4 * spark.sparkContext.defaultParallelism))))
    ub, ib = max(1, math.ceil(n_users / user_block)), max(1, math.ceil(n_items / item_block))
    # with fewer blocks of users than cores, several tasks share one and split the items
    lanes = min(ib, max(1, math.ceil(2 * spark.sparkContext.defaultParallelism / ub)))
    lane_of = lambda c: F.pmod(F.col(c), F.lit(lanes)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    no, nothing = F.lit(None).cast("binary"), F.lit(None).cast("array<bigint>")
    u = _packed(users, "uid", ub, False).select(F.col("block").alias("ub"), every(lanes).alias("lane"), F.lit(-1).alias("ib"), F.lit(0).alias("kind"),
                                                "ids", "e", "g", nothing.alias("seen_u"), nothing.alias("seen_m"))
    i = _packed(items, "mid", ib, True).select(every(ub).alias("ub"), lane_of("block").alias("lane"), F.col("block").alias("ib"), F.lit(2).alias("kind"),
                                               "ids", "e", "g", nothing.alias("seen_u"), nothing.alias("seen_m"))
    had = (seen.select("uid", "mid").distinct().join(users.select("uid"), "uid", "left_semi").join(items.select("mid"), "mid", "left_semi")
           .groupBy(_block("uid", ub).alias("ub"), _block("mid", ib).alias("ib"))
           .agg(F.collect_list(F.col("uid").cast("bigint")).alias("seen_u"), F.collect_list(F.col("mid").cast("bigint")).alias("seen_m"))
           .select("ub", lane_of("ib").alias("lane"), "ib", F.lit(1).alias("kind"), no.alias("ids"), no.alias("e"), no.alias("g"), "seen_u", "seen_m"))
    rows = (u.unionByName(had).unionByName(i).repartitionById(ub * lanes, (F.col("ub") * lanes + F.col("lane")).cast("int"))
            .sortWithinPartitions("ub", "lane", "ib", "kind"))
    found = rows.mapInArrow(_stream(tower, k, places), "uid bigint, mid bigint, score double")
    return top_k_per_group(found, ["uid"], [F.col("score").desc(), F.col("mid").asc()], k)
