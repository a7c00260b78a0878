"""Whitening of embeddings by incremental eigendecomposition.

The fit list holds each distinct vector once. A task keeps the count, the mean
and the eigendecomposition of the scatter matrix of the vectors it has seen;
each further vector is a rank-one update. The update solves the secular
equation of a diagonal matrix plus a rank-one term, after deflation: entries
that the update does not touch keep their eigenpair, and of two equal
eigenvalues one is rotated out of it. Spectra of two tasks are combined by the
same updates, one for each eigenpair of the second and one for the distance of
the means, in a tree over the tasks. A last pass projects all vectors on the
basis found and solves the projected problem (Rayleigh-Ritz). The basis spans
the whole space, so that this gives the eigenvectors of the covariance to
double precision whatever rounding the updates have gathered.

Tasks read their vectors in order and partial sums are added in the order of
the tasks, so that a task that runs again gives the same bits. What reaches the
driver is one spectrum (d x d) for each length of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import prepare, released

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries beyond this are held to it, so that integers stay exact in doubles.
BOUND = 1 << 53
#: Vectors a task updates its spectrum with, or 16 times their length if that is more.
ROWS = 2048
#: Spectra or partial sums that one task combines.
FAN = 16
#: Updates after which the basis is made orthonormal again.
FRESH = 512
#: Vectors projected together.
BLOCK = 4096

_EPS = np.finfo(np.float64).eps
_PARTS = "dim int, part int, n bigint, a binary, b binary, c binary"


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues mu of diag(d) + rho z z', and the matrix d_i - mu_j.

    d ascends strictly, no z is 0 and rho > 0. Each root lies between two poles
    and is sought as its distance from the nearer one, by a rational
    approximation with both poles, held within a shrinking bracket."""
    k = len(d)
    w = rho * z * z
    upper = np.append(d[1:], d[-1] + w.sum())
    middle = (d + upper) / 2
    at_middle = 1 + (w / (d - middle[:, None])).sum(axis=1)
    near = np.arange(k) + ((at_middle < 0) & (np.arange(k) < k - 1))
    gap = d - d[near][:, None]  # row j: poles as seen from the origin of root j
    low, high = d - d[near], upper - d[near]
    half = middle - d[near]
    low, high = np.where(at_middle < 0, half, low), np.where(at_middle < 0, high, half)
    eta = (low + high) / 2
    below = np.tri(k, dtype=bool)  # poles i <= j
    row = np.arange(k)
    after = np.minimum(row + 1, k - 1)
    done = np.zeros(k, bool)
    for _ in range(80):
        delta = gap - eta[:, None]
        delta[delta == 0] = np.finfo(np.float64).tiny
        terms = w / delta
        slopes = terms / delta
        psi, phi = np.where(below, terms, 0).sum(axis=1), np.where(below, 0, terms).sum(axis=1)
        f = 1 + psi + phi
        done |= np.abs(f) <= 4 * _EPS * (1 + np.abs(psi) + np.abs(phi))
        rising = f < 0
        low, high = np.where(rising & ~done, eta, low), np.where(~rising & ~done, eta, high)
        done |= high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))
        if done.all():
            break
        dpsi, dphi = np.where(below, slopes, 0).sum(axis=1), np.where(below, 0, slopes).sum(axis=1)
        one, two = delta[row, row], delta[row, after]
        with np.errstate(all="ignore"):
            c = f - one * dpsi - two * dphi
            b = (one + two) * f - one * two * (dpsi + dphi)
            root = np.sqrt(np.abs(b * b - 4 * one * two * f * c))
            step = np.where(b <= 0, (b - root) / (2 * c), 2 * one * two * f / (b + root))
            step[-1] = one[-1] + dpsi[-1] * one[-1] ** 2 / (f[-1] - dpsi[-1] * one[-1])
            new = eta + step
        inside = (new > low) & (new < high)
        eta = np.where(done, eta, np.where(inside, new, (low + high) / 2))
    delta = gap - eta[:, None]
    delta[delta == 0] = np.finfo(np.float64).tiny
    return d[near] + eta, delta.T


def rank_one(values: np.ndarray, basis: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of basis (diag(values) + rho z z') basis'. values ascend, rho > 0."""
    size = float(np.sqrt(z @ z))
    if size == 0 or rho == 0:
        return values, basis
    z, rho = z / size, rho * size * size
    tol = 8 * _EPS * max(abs(values[0]), abs(values[-1]), rho)
    values, basis = values.copy(), basis.copy()
    active = np.flatnonzero(rho * np.abs(z) > tol)
    if len(active) > 1:
        i, j = active[:-1], active[1:]
        close = (values[j] - values[i]) * np.abs(z[i] * z[j]) <= tol * (z[i] ** 2 + z[j] ** 2)
        if close.any():
            kept, prev = [], active[0]
            for nxt in active[1:]:
                tau = float(np.hypot(z[nxt], z[prev]))
                c, s = z[nxt] / tau, -z[prev] / tau
                if (values[nxt] - values[prev]) * abs(c * s) <= tol:  # one of two equal eigenvalues leaves the update
                    p, q = basis[:, prev].copy(), basis[:, nxt].copy()
                    basis[:, prev], basis[:, nxt] = c * p + s * q, c * q - s * p
                    vp, vn = values[prev], values[nxt]
                    values[prev], values[nxt] = vp * c * c + vn * s * s, vp * s * s + vn * c * c
                    z[nxt], z[prev] = tau, 0.0
                else:
                    kept.append(prev)
                prev = nxt
            active = np.array([*kept, prev])
    if len(active):
        d = values[active]
        mu, delta = secular_roots(d, z[active], rho)
        # z for which the computed roots are exact: keeps the eigenvectors orthogonal
        between = d - d[:, None]
        np.fill_diagonal(between, 1.0)
        exact = np.sqrt(np.abs(np.prod(-delta / between, axis=1)))
        vectors = np.copysign(exact, z[active])[:, None] / delta
        vectors /= np.sqrt((vectors * vectors).sum(axis=0))
        values[active], basis[:, active] = mu, basis[:, active] @ vectors
    order = np.argsort(values, kind="stable")
    return values[order], np.ascontiguousarray(basis[:, order])


@dataclass
class Spectrum:
    """Count, mean and eigendecomposition of the scatter matrix of the vectors added."""
    dim: int
    n: int = 0
    mean: np.ndarray = field(default=None)
    values: np.ndarray = field(default=None)
    basis: np.ndarray = field(default=None)
    updates: int = 0

    def __post_init__(self):
        if self.mean is None:
            self.mean, self.values, self.basis = np.zeros(self.dim), np.zeros(self.dim), np.eye(self.dim)

    def update(self, v: np.ndarray, rho: float) -> None:
        self.values, self.basis = rank_one(self.values, self.basis, self.basis.T @ v, rho)
        self.updates += 1
        if self.updates % FRESH == 0:
            self.basis = orthonormal(self.basis)

    def add(self, x: np.ndarray) -> None:
        """One more vector: a centred rank-one update."""
        away = x - self.mean
        if self.n:
            self.update(away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        """The other's vectors too: one update per eigenpair, and one for the distance of the means."""
        for value, column in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self.update(column, float(value))
        away, total = other.mean - self.mean, self.n + other.n
        self.update(away, self.n * other.n / total)
        self.mean = self.mean + away * (other.n / total)
        self.n = total


def orthonormal(basis: np.ndarray) -> np.ndarray:
    q, r = np.linalg.qr(basis)
    return q * np.sign(np.diag(r) + 0.5 * (np.diag(r) == 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as an integer matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the vectors x of each length."""
    column = batch.column("x")
    sizes = np.diff(column.offsets.to_numpy())
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, _matrix(column.take(pa.array(at)))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["dim", "part", "n", "a", "b", "c"])


def _bytes(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a, np.float64).tobytes() for a in arrays]


def _floats(data: bytes) -> np.ndarray:
    return np.frombuffer(data) if data else np.zeros(0)


def _decomposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spectrum per length of the task's vectors, relative to SHIFT."""
    part, spectra = TaskContext.get().partitionId(), {}
    for batch in released(batches):
        for dim, _, x in _by_dim(batch):
            own = spectra.setdefault(dim, Spectrum(dim))
            for v in (x - SHIFT).astype(np.float64):
                own.add(v)
    yield _rows([(d, part, s.n, *_bytes(s.mean, s.values, s.basis)) for d, s in sorted(spectra.items())])


def _merged(parts: list[dict]) -> tuple:
    spectra = [Spectrum(r["dim"], r["n"], *(_floats(r[c]).copy() for c in "ab"), _floats(r["c"]).reshape(r["dim"], r["dim"]).copy()) for r in parts]
    first = max(spectra, key=lambda s: s.n)  # the largest takes the others in
    for s in spectra:
        if s is not first:
            first.merge(s)
    first.basis = orthonormal(first.basis)
    return first.n, *_bytes(first.mean, first.values, first.basis)


def _added(parts: list[dict]) -> tuple:
    return sum(r["n"] for r in parts), *_bytes(*(sum(_floats(r[c]) for r in parts) for c in "abc"))


def _combined(parts: DataFrame, tasks: int, combine: Callable[[list[dict]], tuple]) -> DataFrame:
    """One row per length of vectors: ``combine`` over a tree of tasks, in their order."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").to_pylist()
        return pa.Table.from_batches([_rows([(key[0].as_py(), key[1].as_py(), *combine(rows))])])

    parts = parts.checkpoint()
    while True:
        tasks = -(-tasks // FAN)
        parts = parts.groupBy("dim", F.floor(F.col("part") / FAN).cast("int").alias("group")).applyInArrow(run, _PARTS).checkpoint()
        if tasks == 1:
            return parts


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and sums per place, as high and low halves that add up without overflow."""
    found: dict = {}
    for batch in released(batches):
        for dim, _, x in _by_dim(batch):
            n, high, low = found.get(dim, (0, 0, 0))
            found[dim] = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
    rows = [(d, i, n, int(h[i]), int(lo[i])) for d, (n, h, lo) in found.items() for i in range(d)]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), *[pa.int64()] * 3))],
                                     names=["dim", "place", "n", "high", "low"])


@dataclass
class Model:
    """Whitening of vectors of one length: n and exact sums of the fit list, components as columns, their eigenvalues, the trace."""
    n: int
    sums: list[int]
    basis: np.ndarray
    values: np.ndarray = field(default=None)
    trace: float = 0.0
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, from exact integers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.basis / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2; null beyond a long."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        away = x - whole
        if self.n * (float(np.abs(away).max(initial=0)) + 1) < 2.0 ** 31 / max(1, len(whole)) ** 0.5:
            t = self.n * away - rest
            return (t * t).sum(axis=1).tolist()
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(v, rest.tolist(), strict=True)) for v in away.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def _products(models, project: Callable):
    """Per length the task's sums of y and y y' over its vectors, y = project(model, x)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = TaskContext.get().partitionId(), {}
        for batch in released(batches):
            for dim, _, x in _by_dim(batch):
                for lo in range(0, len(x), BLOCK):
                    y = project(models.value[dim], x[lo:lo + BLOCK])
                    n, total, square = found.get(dim, (0, 0, 0))
                    found[dim] = n + len(y), total + y.sum(axis=0), square + y.T @ y
        yield _rows([(d, part, n, *_bytes(t, s, np.zeros(0))) for d, (n, t, s) in sorted(found.items())])
    return run


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x = floor(64 c) + 1000000 of the rows whose vector is not null, not empty and has finite entries only."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    good = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.least(F.greatest(c * SCALE, F.lit(-float(BOUND))), F.lit(float(BOUND)))
    return v.where(F.col("e").isNotNull() & (F.size("e") > 0)).where(good).select("vec_id", F.transform("e", lambda c: F.floor(held(c)).cast("bigint") + SHIFT).alias("x"))


def fit(x: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of vectors in ``x``."""
    spark = x.sparkSession
    listed = x.select("x").distinct().checkpoint()
    models: dict[int, Model] = {}
    for r in listed.mapInArrow(_sums, "dim int, place int, n bigint, high bigint, low bigint").groupBy("dim", "place").agg(
            F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("dim", "place").collect():
        models.setdefault(r.dim, Model(r.n, [], np.eye(0))).sums.append((r.high << 32) + r.low)
    if not models:
        return models
    tasks = max(1, -(-sum(m.n for m in models.values()) // max(ROWS, 16 * max(models))))
    dealt = listed.repartition(tasks, "x").sortWithinPartitions("x").checkpoint()
    tasks = max(tasks, dealt.rdd.getNumPartitions())

    def reduced(run: Callable, combine: Callable) -> list:
        return _combined(dealt.mapInArrow(run, _PARTS), tasks, combine).collect()

    for r in reduced(_decomposed, _merged):
        models[r.dim].basis = orthonormal(_floats(r.c).reshape(r.dim, r.dim))
    for r in reduced(_products(spark.sparkContext.broadcast(models), lambda m, v: m.centred(v) @ m.basis), _added):
        m = models[r.dim]
        values, vectors = np.linalg.eigh(_floats(r.b).reshape(r.dim, r.dim) / m.n)
        m.trace = float(values.sum())
        top = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > max(r.dim * 16 * _EPS * m.trace, 0.0)]
        m.values = values[top]
        m.basis = m.basis @ vectors[:, top]
        m.basis = m.basis / np.sqrt((m.basis ** 2).sum(axis=0))
        if len(top):
            m.basis = m.basis * np.sign(m.basis[np.abs(m.basis).argmax(axis=0), np.arange(len(top))])
    for r in reduced(_products(spark.sparkContext.broadcast(models), Model.whitened), _added):
        m = models[r.dim]
        mean, k = _floats(r.a) / m.n, len(m.values)
        error = _floats(r.b).reshape(k, k) / m.n - np.outer(mean, mean) - np.eye(k)
        m.identity_error = float(np.abs(error).max(initial=0))
    return models


def _project(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for dim, at, x in _by_dim(batch):
                m = models.value[dim]
                k = len(m.values)
                for lo in range(0, len(x), BLOCK) if k else ():
                    some = x[lo:lo + BLOCK]
                    rows, many = len(some), len(some) * k
                    ids = batch.column("vec_id").take(pa.array(np.repeat(at[lo:lo + BLOCK], k)))
                    deviation = [d for d in m.deviations(some) for _ in range(k)]
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(many, m.n)), pa.array(deviation, pa.int64()),
                         pa.array(m.whitened(some).ravel()), pa.array(np.tile(m.values / m.trace, rows)), pa.array(np.full(many, m.identity_error))],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and
    identity_error, one row per row of ``vectors`` and component.

    Rows whose vector is null, empty or holds null or non-finite entries are
    dropped; entries beyond 2^53 are held to it. Rows without a vec_id, and
    repeated rows, each get their rows; the fit counts a vector once. Equal
    eigenvalues are numbered as found. Components without variance (no more
    than rounding) are left out, so that a table of one distinct vector, like
    an empty one, gives no rows. Vectors of different lengths are fitted apart.
    A deviation that a long cannot hold is null. Other columns are ignored,
    whatever their names. An update costs d^3 operations for vectors of length
    d, and a task holds a few d x d matrices.
    """
    prepare(vectors.sparkSession)
    x = integer_vectors(vectors)
    models = vectors.sparkSession.sparkContext.broadcast(fit(x, components))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return x.mapInArrow(_project(models), f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
