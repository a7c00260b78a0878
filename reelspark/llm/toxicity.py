"""Toxic passages as maximum-scoring segments of token log-odds.

Training: in how many toxic and in how many other labelled documents a token
(hashed into ``BUCKETS``) occurs gives its log-odds under Dirichlet priors whose
weight follows the token's share of all labelled documents; a token scores what
its log-odds are sure to exceed (``SURE`` standard deviations below the
estimate), and nothing if that is not positive. Every token pays ``DRIFT``, so
that chance sums stay low.

Scoring: one linear scan per document finds all maximal scoring segments.
Under the extreme-value law a clean text of n tokens reaches a segment score S
with expected frequency K n exp(-lambda S): lambda solves
sum p(s) exp(lambda s) = 1 over the clean documents' token scores, K comes from
their best segments. -ln of that frequency, summed over the segments it calls
significant, is the document's evidence, which a two-parameter logistic curve,
fitted on the training labels, turns into a probability.

Everything is counted over all labelled rows; what the driver receives is
bounded by BUCKETS and by the bins of the calibration, not by the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import KEY, binary_values, broadcast_if, hash_words, list_array, prepare, released, row_key
from reelspark.llm.decontaminate import item_words

BUCKETS = 1 << 22
PRIOR = 0.5
PRIOR_WEIGHT = 10.0
SURE = 2.33
DRIFT = 0.25
#: A segment counts as a toxic passage if a clean text has one this good less often than this.
SIGNIFICANT = 0.05
HELD_OUT = 2
THRESHOLD = 0.3
_BINS, _BIN = 400, 0.25


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  # sorted buckets with a positive score
    scores: np.ndarray
    lam: float
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = 0.0


def _buckets(text: bytes) -> np.ndarray:
    return (hash_words(item_words(text)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, toxic documents, other documents) of a task; bucket -1 counts the documents themselves."""
    seen = np.zeros((2, BUCKETS), np.int32)
    docs = [0, 0]
    for batch in released(batches):
        for toxic, text in zip(batch.column("toxic").to_pylist(), binary_values(batch.column("text")), strict=True):
            seen[toxic][np.unique(_buckets(text))] += 1
            docs[toxic] += 1
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], at)).astype(np.int32)),
                                      pa.array(np.concatenate(([docs[1]], seen[1][at])).astype(np.int64)),
                                      pa.array(np.concatenate(([docs[0]], seen[0][at])).astype(np.int64))], names=["bucket", "n1", "n0"])


def _solve_lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum w exp(lambda s) = 1."""
    lo, hi = 0.0, 1.0
    value = lambda x: float(np.log(np.sum(weights * np.exp(np.clip(x * scores, -700, 700)))))
    while value(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return hi


def fit_scores(labelled: DataFrame) -> Model | None:
    """Token scores and lambda from (text, toxic) rows; None without both labels."""
    counts = labelled.mapInArrow(_count, "bucket int, n1 bigint, n0 bigint").groupBy("bucket").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).checkpoint()
    docs = counts.where("bucket = -1").first()
    if docs is None or not docs["n1"] or not docs["n0"]:
        return None
    clean_tokens = counts.where("bucket >= 0").agg(F.sum("n0")).first()[0]
    table = counts.where("bucket >= 0 and n1 > 0").toArrow()  # at most BUCKETS rows
    b, y1, y0 = (table.column(c).to_numpy() for c in ("bucket", "n1", "n0"))
    n1, n0 = docs["n1"], docs["n0"]
    prior = PRIOR + PRIOR_WEIGHT * (y1 + y0) / (n1 + n0)
    a1, a0 = y1 + prior, y0 + prior
    odds = np.log(a1 / (n1 + 2 * prior)) - np.log(a0 / (n0 + 2 * prior))
    sure = odds - SURE * np.sqrt(1 / a1 + 1 / a0)
    use = sure > DRIFT
    order = np.argsort(b[use])
    scores = sure[use][order] - DRIFT
    # clean documents' token scores, one token added at the best score so that the root exists
    weights = np.concatenate((y0[use][order], [1.0, max(clean_tokens - y0[use].sum(), 1)])).astype(float)
    values = np.concatenate((scores, [scores.max() if len(scores) else 1.0, -DRIFT]))
    return Model(b[use][order].astype(np.int64), scores, _solve_lambda(values, weights / weights.sum()))


def maximal_segments(at: np.ndarray, scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first token, end token) of a token
    sequence in which token at[i] scores scores[i] and every other -DRIFT."""
    segments: list[tuple[float, int, int, float]] = []  # left sum, first, end, right sum
    total, done = 0.0, 0
    for p, s in zip(at.tolist(), scores.tolist(), strict=True):
        total -= DRIFT * (p - done)
        left, first, total, done = total, p, total + s, p + 1
        segment = (left, first, done, total)
        while True:
            j = len(segments) - 1
            while j >= 0 and segments[j][0] >= segment[0]:
                j -= 1
            if j < 0 or segments[j][3] >= segment[3]:
                segments.append(segment)
                break
            segment = (segments[j][0], segments[j][1], segment[2], segment[3])
            del segments[j:]
    return [(right - left, first, end) for left, first, end, right in segments]


_SEGMENTS = f"doc_id bigint, {KEY} bigint, n_tokens bigint, best double, segments array<struct<score:double,first:int,end:int>>"
_SEGMENT = pa.struct([("score", pa.float64()), ("first", pa.int32()), ("end", pa.int32())])


def _find(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, np.float32)
        table[model.buckets] = model.scores
        for batch in released(batches):
            n, best, found = [], [], []
            for text in binary_values(batch.column("text")):
                s = table[_buckets(text)]
                at = np.flatnonzero(s)
                segments = maximal_segments(at, s[at].astype(float)) if len(at) else []
                n.append(len(s))
                best.append(max((x[0] for x in segments), default=0.0))
                found.append(segments)
            flat = [dict(zip(("score", "first", "end"), x, strict=True)) for xs in found for x in xs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column(KEY), pa.array(n, pa.int64()), pa.array(best, pa.float64()),
                 list_array(np.array([len(x) for x in found], np.int64), pa.array(flat, _SEGMENT))],
                names=["doc_id", KEY, "n_tokens", "best", "segments"])
    return run


def _logistic(x: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through binned labels, by Newton steps with a weak prior."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (n1 - (n1 + n0) * p) - 0.01 * w
        hessian = design.T @ (design * ((n1 + n0) * p * (1 - p))[:, None]) + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_tokens, evidence, passages per row of ``docs``.

    Labels of rows whose crc32(doc_id as text) mod 4 is 2 are held out of all
    fitting. passages are the significant segments (first token, end token,
    score). Null and empty texts have no tokens and get the lowest score; a row
    without a doc_id is never a training row, and not held out. Repeated rows
    each get a row; a document with several labels counts once per label row;
    null labels are left out. Without labels of both kinds every score is 0.
    Other columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key(F.col("text")).alias(KEY), "text")
    marks = (labels.select(F.col("doc_id").cast("bigint").alias("__reel_id"), F.col("toxic").cast("int").alias("toxic"))
             .where((fold("__reel_id") != HELD_OUT) & F.col("toxic").isin(0, 1)).checkpoint())
    marks = broadcast_if(marks, marks.count())
    model = fit_scores(rows.join(marks, rows["doc_id"] == marks["__reel_id"]).select("text", "toxic"))
    held = F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out")
    if model is None:
        return rows.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).cast("bigint").alias("n_tokens"),
                           F.lit(0.0).alias("evidence"), F.array().cast("array<struct<score:double,first:int,end:int>>").alias("passages"))
    found = rows.mapInArrow(_find(model), _SEGMENTS).checkpoint()
    train = found.join(marks, found["doc_id"] == marks["__reel_id"])
    # best segments of clean texts: lambda S - ln n is Gumbel distributed about ln K
    centre = train.where("toxic = 0 and n_tokens > 0").agg(F.avg(F.lit(model.lam) * F.col("best") - F.log("n_tokens"))).first()[0]
    log_k = (centre if centre is not None else 0.0) - 0.5772156649
    strength = lambda s: F.lit(model.lam) * s - F.lit(log_k) - F.log(F.greatest(F.col("n_tokens"), F.lit(1)))
    significant = F.filter("segments", lambda s: strength(s["score"]) > -np.log(SIGNIFICANT))
    evidence = F.aggregate(significant, F.lit(0.0), lambda a, s: a + strength(s["score"]))
    found = found.withColumn("passages", significant).withColumn("evidence", F.when(F.size("passages") > 0, evidence).otherwise(F.greatest(strength(F.col("best")), F.lit(0.0))))
    bins = (found.join(marks, found["doc_id"] == marks["__reel_id"])
            .groupBy(F.least(F.floor(F.col("evidence") / _BIN), F.lit(_BINS)).cast("int").alias("bin"))
            .agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")).collect())  # at most _BINS + 1 rows
    x, y1, y0 = (np.array([r[c] for r in bins], float) for c in ("bin", "n1", "n0"))
    slope, offset = _logistic(x * _BIN, y1, y0)
    slope = max(slope, 1e-6)
    score = 1 / (1 + F.exp(-(F.lit(slope) * F.least(F.col("evidence"), F.lit(_BINS * _BIN)) + offset)))
    return (found.withColumn("score", score)
            .select("doc_id", held, "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_tokens", "evidence", "passages"))
