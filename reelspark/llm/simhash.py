"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits: bit b is 1 if it is set in over half of the XXH64
values of the text's 3-word shingles. Documents link when their fingerprints
differ in at most 2 bits; only distinct fingerprints are compared.

The bits are grouped into m parts, correlated bits together. If two
fingerprints differ in at most d bits and the parts' thresholds add up to
d - m + 1, some part differs in at most its own threshold (-1: the part is not
asked). Every fingerprint gets thresholds of its own: a dynamic programme over
the parts picks those with the least probes and estimated candidates, from the
exact count of the part's value and, for thresholds above 0, the share of
pairs that are so near in the part. It then probes the index of part values
and verifies what it meets.

The probes' exact numbers of candidates are counted before any pair is made. A
fingerprint that would meet more than ``LIMIT`` is not probed but looked up
from both sides: it and its 64 neighbours at one bit are keys, and two
fingerprints differ in at most two bits exactly if they share a key. A key has
at most 65 fingerprints, any two of which are linked through the least of them.
A pair is found if either end probes, and by its keys if neither does, so no
link is lost, and no bucket of any size is turned into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import binary_values, broadcast_if, gathered, prepare, released
from reelspark.llm.components import connected_components

BITS = 64
DISTANCE = 2
SHINGLE = 3
SEED = 42
#: Candidates a fingerprint may meet by its probes; its own bit neighbourhood costs about as many rows.
LIMIT = BITS
#: Shingles counted together.
BLOCK = 1 << 14


def shingle_hashes(text: bytes) -> list[int]:
    words = text.lower().split()
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-SHINGLE].tolist()]
    spans = map(joined.__getitem__, map(slice, starts, (ends[SHINGLE - 1:] - 1).tolist()))
    return list(map(xxhash.xxh64_intdigest, spans, repeat(SEED)))


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text; 0 without words."""
    hashes = np.array(shingle_hashes(text), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[lo:lo + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        texts = binary_values(batch.column("text"))
        prints = np.array([fingerprint(t) for t in texts], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a bigint) per row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_mark, "doc_id bigint, fp bigint")


def _bits(prints: np.ndarray) -> np.ndarray:
    """(n, 64) of 0 and 1; column b is bit b."""
    return np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often bits i and j are both 1, summed over the task's rows."""
    total = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        prints = _unsigned(batch.column("fp"))
        for lo in range(0, len(prints), BLOCK):
            bits = _bits(prints[lo:lo + BLOCK]).astype(np.float32)  # counts below 2^24 are exact
            total += (bits.T @ bits).astype(np.int64)
    i, j = np.divmod(np.arange(BITS * BITS, dtype=np.int32), BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "n"])


def bit_statistics(prints: DataFrame) -> np.ndarray:
    """(64, 64) counts of bits that are 1 together, over all fingerprints."""
    rows = prints.mapInArrow(_together, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((BITS, BITS), np.int64)
    for r in rows:
        out[r.i, r.j] = r.n
    return out


def grouped_bits(together: np.ndarray, n: int, parts: int) -> list[np.ndarray]:
    """Bits dealt to parts of about equal size, each next to those it correlates with most.

    A part starts with the free bit most correlated with any other and takes
    the bits with the largest mean absolute correlation with its members, so
    that what varies together is asked once and the other parts tell more."""
    p = np.diag(together) / n
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / n - np.outer(p, p)) / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = (BITS + k) // parts
        part = [max(free, key=lambda b: (corr[b, free].max(), -b))]
        free.remove(part[0])
        while len(part) < size:
            best = max(free, key=lambda b: (round(corr[b, part].mean(), 9), -b))
            part.append(best)
            free.remove(best)
        out.append(np.array(sorted(part)))
    return out


def part_values(prints: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """(n, parts): the bits of each part, closed up."""
    bits = _bits(prints).astype(np.int64)
    return np.stack([bits[:, p] @ (np.int64(1) << np.arange(len(p))) for p in parts], axis=1)


def number_of_parts(n: int) -> int:
    """Parts so wide that evenly spread fingerprints would seldom share a part's value, 2 to 4."""
    return max(2, min(4, BITS // max(1, n.bit_length())))


def near_shares(together: np.ndarray, n: int, parts: list[np.ndarray]) -> np.ndarray:
    """(parts, 1 + DISTANCE): estimated share of pairs that differ in exactly 0, 1, 2 bits of a part, from the bits' means."""
    p = np.diag(together) / n
    out = np.zeros((len(parts), 1 + DISTANCE))
    for k, bits in enumerate(parts):
        dist = np.zeros(1 + DISTANCE)
        dist[0] = 1
        for b in bits:
            differ = 2 * p[b] * (1 - p[b])
            dist[1:] = dist[1:] * (1 - differ) + dist[:-1] * differ
            dist[0] *= 1 - differ
        out[k] = dist
    return out


def thresholds(counts: np.ndarray, shares: np.ndarray, n: int, widths: list[int]) -> np.ndarray:
    """(fingerprints, parts): the thresholds, -1 to DISTANCE, of least cost that
    add up to DISTANCE - parts + 1. ``counts`` has how many fingerprints have the
    same part value. The cost is the probes and the estimated candidates."""
    rows, m = counts.shape
    budget = DISTANCE + 1  # thresholds plus one per part, added up
    best = np.full((rows, budget + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((m, rows, budget + 1), np.int64)
    for k in range(m):
        cost = np.zeros((rows, budget + 1))  # by threshold + 1
        for t in range(DISTANCE + 1):
            probes = sum(comb(widths[k], d) for d in range(t + 1))
            cost[:, t + 1] = probes + counts[:, k] + n * shares[k, 1:t + 1].sum()
        total = np.full_like(best, np.inf)
        for spent in range(budget + 1):
            for use in range(spent + 1):
                c = best[:, spent - use] + cost[:, use]
                better = c < total[:, spent]
                total[better, spent] = c[better]
                choice[k, better, spent] = use
        best = total
    out = np.zeros((rows, m), np.int64)
    spent = np.full(rows, budget)
    for k in range(m - 1, -1, -1):
        use = choice[k, np.arange(rows), spent]
        out[:, k] = use - 1
        spent -= use
    return out


def _masks(width: int) -> list[np.ndarray]:
    """Masks of exactly 0, 1, 2 bits."""
    one = np.int64(1) << np.arange(width)
    i, j = np.triu_indices(width, 1)
    return [np.zeros(1, np.int64), one, one[i] | one[j]]


def _values(parts: list[np.ndarray]):
    """(fp, part, value) of every fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            fp = batch.column("fp").to_numpy()
            v = part_values(_unsigned(batch.column("fp")), parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, len(parts))), pa.array(np.tile(np.arange(len(parts), dtype=np.int32), len(fp))),
                                              pa.array(v.ravel())], names=["fp", "part", "value"])
    return run


def _probes(parts: list[np.ndarray], shares: np.ndarray, n: int):
    """(fp, part, value) of all values within the thresholds that suit a fingerprint; ``counts`` is an array by part."""
    masks = [_masks(len(p)) for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for lo in range(0, batch.num_rows, 4096):
                some = batch.slice(lo, 4096)
                fp = some.column("fp").to_numpy()
                values = part_values(_unsigned(some.column("fp")), parts)
                counts = np.stack([some.column(f"n{k}").to_numpy() for k in range(len(parts))], axis=1)
                chosen = thresholds(counts, shares, n, [len(p) for p in parts])
                for k in range(len(parts)):
                    for t in range(DISTANCE + 1):
                        at = np.flatnonzero(chosen[:, k] >= t)
                        if len(at):
                            asked = values[at, k][:, None] ^ masks[k][t][None, :]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.repeat(fp[at], asked.shape[1])), pa.array(np.full(asked.size, k, np.int32)), pa.array(asked.ravel())],
                                names=["fp", "part", "value"])
    return run


def _links_by_probes(prints: DataFrame, n: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) found from fingerprints that meet at most ``limit`` candidates; the other fingerprints."""
    together = bit_statistics(prints)
    parts = grouped_bits(together, n, number_of_parts(n))
    shares = near_shares(together, n, parts)
    m = len(parts)
    index = prints.mapInArrow(_values(parts), "fp bigint, part int, value bigint")
    counts = gathered(index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")), m * n).checkpoint()
    counted = gathered(index.join(counts, ["part", "value"]), m * n).checkpoint()
    own = counted.groupBy("fp").agg(*[F.max(F.when(F.col("part") == k, F.col("n"))).alias(f"n{k}") for k in range(m)])
    probes = own.mapInArrow(_probes(parts, shares, n), "fp bigint, part int, value bigint")
    met = gathered(probes.join(counts, ["part", "value"]), m * n).checkpoint()
    most = limit + m  # a fingerprint meets itself, in each part at most
    many = gathered(met.groupBy("fp").agg(F.sum("n").alias("total")).where(F.col("total") > most).select("fp"), n).checkpoint()
    asked = (met.where(F.col("n") <= most).join(broadcast_if(many, many.count()), "fp", "left_anti")
             .select(F.col("fp").alias("q"), "part", "value"))
    near = F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= DISTANCE
    found = counted.where(F.col("n") <= most).join(asked, ["part", "value"]).where((F.col("q") != F.col("fp")) & near)
    return found.select(F.greatest("q", "fp").alias("u"), F.least("q", "fp").alias("v")).distinct(), many


def _links_by_neighbours(prints: DataFrame) -> DataFrame:
    """Links between fingerprints that share a key: themselves or a neighbour at one bit. Each key links its fingerprints to the least."""
    masks = F.array(F.lit(0).cast("bigint"), *[F.shiftleft(F.lit(1).cast("bigint"), b) for b in range(BITS)])
    keys = prints.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("key"))
    groups = keys.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    return (groups.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u <> v").select("u", "v").distinct())


def fingerprint_links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (u, v) over distinct fingerprints (fp) that connect all that differ
    in at most two bits, directly or through others that do."""
    n = prints.count()
    if n < 2:
        return prints.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where("false")
    found, many = _links_by_probes(prints, n, limit)
    return found.unionByName(_links_by_neighbours(many))


def simhash_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id
    reachable, itself included), one row per row of ``docs``.

    Texts that are null, empty or without words have fingerprint zero, which
    links like any other; up to three words are one shingle. A row whose doc_id
    is null takes part; it gets the least doc_id of its component, or null if
    there is none. Repeated rows each get a row; rows of one doc_id may lie in
    different components. Very long texts are hashed whole; a worker holds a few
    times the text. Other columns are ignored, whatever their names; an empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)
    marks = fingerprints(docs).checkpoint()
    rows = marks.count()
    classes = gathered(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), rows).checkpoint()
    components = connected_components(fingerprint_links(classes.select("fp"), limit))
    linked = classes.join(components, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = linked.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    named = gathered(named, rows).checkpoint()
    return (marks.join(broadcast_if(named, named.count()), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
