"""MinHash near-duplicates: universal hash minima, banding, signature
verification, confirmation on the full sets, connected components.

Texts are lower-cased (A-Z) and cut into words at ASCII white space; a
document's set holds its distinct 5-word shingles (fewer words: the whole
sequence as one shingle; no words: the empty set, linked with nothing).

Documents with equal sets form one class; only classes are compared. Classes
meet in a bucket when one band of their signature agrees. Within a bucket no
list of all pairs is made. Members with too many shingles that nobody else in
any bucket has are out at once: no other set reaches them. The rest is compared
with one centre, the member with the fewest shingles of its own (a group of
edited copies gathers about its original), and while members in different
components remain, with 16, 256, ... further centres, members without a link
first. A bucket is finished when the members that
have not been a centre lie in one component, so every pair of a bucket has
been compared or is connected already: no link between components is lost.

With 192 minima in 32 bands of 6 a pair at similarity 0.85 shares no band with
probability 3e-7 (0.8: 6e-5). The signature check drops pairs more than five
standard deviations below the threshold. What remains is decided on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspark.llm.common import KEY, _odd, binary_values, broadcast_if, hash_words, list_array, ngram_hashes, prepare, released, row_key, slices
from reelspark.llm.components import connected_components

SHINGLE = 5
MINIMA = 192
ROWS_PER_BAND = 6
#: Growth of the number of centres a bucket gets from one round to the next.
FAN = 16
#: Shingles hashed together; keeps the working arrays in the processor cache.
BLOCK = 1 << 17

_MARKS = f"doc_id bigint, {KEY} bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, sig binary"


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    words = hash_words(text.lower().split())
    return np.unique(ngram_hashes(words, min(SHINGLE, len(words)))) if len(words) else np.empty(0, np.uint64)


def _minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, MINIMA): minimum of a*x+b over each set, for every (a, b)."""
    a, b = _odd(21, MINIMA), _odd(22, MINIMA)
    out = np.empty((len(starts), MINIMA), np.uint64)
    work = np.empty_like(values)
    for j in range(MINIMA):
        np.multiply(values, a[j], out=work)
        work += b[j]
        out[:, j] = np.minimum.reduceat(work, starts)
    return out >> np.uint64(32)


def _bands(minima: np.ndarray) -> np.ndarray:
    """(sets, bands): one hash per band, salted with the band's number."""
    n, b = len(minima), MINIMA // ROWS_PER_BAND
    mult = _odd(23, ROWS_PER_BAND)
    key = np.broadcast_to(_odd(24, b), (n, b)).copy()
    grouped = minima.reshape(n, b, ROWS_PER_BAND)
    for r in range(ROWS_PER_BAND):
        key ^= grouped[:, :, r] * mult[r]
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        texts = binary_values(batch.column("text"))
        for lo, hi in slices([len(t) // 6 for t in texts], BLOCK):
            sets = [shingle_set(t) for t in texts[lo:hi]]
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            keys = np.zeros((len(sets), 2), np.int64)
            for i in full:
                keys[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[i].tobytes()), np.int64)
            counts = np.where(sizes > 0, MINIMA // ROWS_PER_BAND, 0)
            bands, sigs = np.empty(0, np.uint64), [b""] * len(sets)
            if len(full):
                starts = np.zeros(len(full), np.int64)
                np.cumsum(sizes[full][:-1], out=starts[1:])
                minima = _minima(np.concatenate([sets[i] for i in full]), starts)
                bands = _bands(minima).ravel()
                low = (minima & np.uint64(0xFF)).astype(np.uint8)
                for i, row in zip(full, low, strict=True):
                    sigs[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), batch.column(KEY).slice(lo, hi - lo), pa.array(sizes),
                 pa.array(keys[:, 0]), pa.array(keys[:, 1]), list_array(counts, _signed(bands)),
                 pa.array(sigs, pa.binary())],
                names=["doc_id", KEY, "n_shingles", "k1", "k2", "bands", "sig"])


def mark(docs: DataFrame) -> DataFrame:
    """One row per document: set size, 128-bit key of the set, band keys, signature."""
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key(F.col("text")).alias(KEY), "text")
            .mapInArrow(_mark, _MARKS))


def _agreeing(least: float):
    """Pairs whose signatures agree in at least this share of the minima."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, MINIMA) for c in ("sa", "sb"))
            keep = pa.array((a == b).mean(axis=1) >= least)
            yield batch.select(["a", "b", "na", "nb"]).filter(keep)
    return run


def _intersect():
    """Size of the intersection of two texts' full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = lru_cache(maxsize=64)(shingle_set)
        for batch in released(batches):
            shared = []
            for left, right in zip(binary_values(batch.column("ta")), binary_values(batch.column("tb")), strict=True):
                x, y = cached(left), cached(right)
                shared.append(len(np.intersect1d(x, y, assume_unique=True)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(shared, pa.int64())],
                                             names=["a", "b", "na", "nb", "inter"])
    return run


def _explode_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        nodes, texts = batch.column("node").to_numpy(), binary_values(batch.column("text"))
        for lo, hi in slices([len(t) // 6 for t in texts], BLOCK):
            sets = [shingle_set(t) for t in texts[lo:hi]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(nodes[lo:hi], [len(s) for s in sets])), _signed(np.concatenate(sets))], names=["node", "h"])


def _partnered(texts: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(node, n, own): nodes that can have a partner among ``texts``, with the size
    of their set and how many of its shingles nobody else has. A set in which
    more than 100 - percent per cent are its own reaches no other set."""
    owned = (texts.mapInArrow(_explode_sets, "node bigint, h bigint").groupBy("h").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))
             .where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own")))
    every = texts.select("node").join(classes.select("node", "n_shingles"), "node").join(owned, "node", "left")
    return (every.select("node", F.col("n_shingles").alias("n"), F.coalesce("own", F.lit(0)).alias("own"))
            .where((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent))


def _reachable(percent: int) -> Column:
    """Whether two sets of a bucket can be similar enough, by what is known of
    each: size n, shingles of its own, shingles shared with the bucket's first
    centre (null: not known). Shingles of one's own are shared with nobody."""
    bound = F.least(F.col("n") - F.col("own"), F.col("bn") - F.col("bown"))
    through = (F.least("inter", "binter")
               + F.least(F.col("n") - F.col("inter") - F.col("own"), F.col("bn") - F.col("binter") - F.col("bown")))
    both = F.when(F.col("inter").isNotNull() & F.col("binter").isNotNull(), F.least(bound, through)).otherwise(bound)
    return both * 100 >= (F.col("n") + F.col("bn") - both) * percent


class _Compare:
    """Sizes of the intersections of candidate pairs (a, b) of classes, by their
    full sets; pairs whose sizes or signatures rule them out are left out."""

    def __init__(self, texts: DataFrame, signed: DataFrame, percent: int):
        """``texts``: (node, text); ``signed``: (node, n_shingles, sig)."""
        self.texts, self.signed, self.percent = texts, signed, percent
        t = percent / 100
        self.least = t - 5 * (t * (1 - t) / MINIMA) ** 0.5

    def __call__(self, pairs: DataFrame) -> DataFrame:
        side = {x: self.signed.select(F.col("node").alias(x), F.col("sig").alias("s" + x), F.col("n_shingles").alias("n" + x)) for x in "ab"}
        close = (pairs.join(side["a"], "a").join(side["b"], "b")
                 .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent)
                 .select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_agreeing(self.least), "a bigint, b bigint, na bigint, nb bigint"))
        return (close.join(self.texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
                .join(self.texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
                .select("a", "b", "na", "nb", "ta", "tb")
                .mapInArrow(_intersect(), "a bigint, b bigint, na bigint, nb bigint, inter bigint").checkpoint())


def _bucket_links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame | None:
    """(node, component) over the classes, or None if nothing is linked."""
    exploded = classes.select("node", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    members = exploded.join(shared, "band").select("band", "node").checkpoint()
    rep = members.select("node").distinct().join(classes.select("node", "rep"), "node").select("node", "rep.*").checkpoint()
    rep = broadcast_if(rep, rep.count())
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key(F.col("text")).alias(KEY), "text")
    texts = (d.join(rep, d["doc_id"].eqNullSafe(rep["doc_id"]) & (d[KEY] == rep[KEY]))
             .select("node", "text").dropDuplicates(["node"]).checkpoint())
    partnered = _partnered(texts, classes, percent).checkpoint()
    facts = ["band", "node", "n", "own", "inter"]
    members = members.join(partnered, "node").withColumn("inter", F.lit(None).cast("bigint")).select(*facts).checkpoint()
    signed = classes.select("node", "n_shingles", "sig").join(partnered.select("node"), "node").checkpoint()
    compare = _Compare(texts, broadcast_if(signed, 4 * signed.count()), percent)  # a signature is as wide as a few rows
    components, fan = None, 1
    while True:
        if components is None:
            labelled = members.withColumn("c", F.col("node")).withColumn("linked", F.lit(0))
        else:
            labelled = (members.join(broadcast_if(components, components.count()), "node", "left")
                        .select(*facts, F.coalesce("component", "node").alias("c"), F.col("component").isNotNull().cast("int").alias("linked")).checkpoint())
        open_bands = labelled.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("band")
        active = labelled.join(open_bands, "band").checkpoint()
        if active.isEmpty():
            return components
        rank = F.row_number().over(Window.partitionBy("band").orderBy("linked", F.col("own") / F.col("n"), "node"))
        chosen = (active.withColumn("r", rank).where(F.col("r") <= fan)
                  .select("band", F.col("node").alias("b"), F.col("c").alias("cb"), F.col("n").alias("bn"), F.col("own").alias("bown"),
                          F.col("inter").alias("binter")).checkpoint())
        pairs = (active.join(chosen, "band").where((F.col("c") != F.col("cb")) & _reachable(percent))
                 .select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct())
        known = compare(pairs)
        links = known.where(F.col("inter") * 100 >= (F.col("na") + F.col("nb") - F.col("inter")) * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))
        if not links.isEmpty():
            components = connected_components(links if components is None else links.unionByName(
                components.select(F.col("node").alias("u"), F.col("component").alias("v"))))
        members = active.select(*facts).join(chosen.select("band", F.col("b").alias("node")), ["band", "node"], "left_anti")
        if fan == 1:  # what each member shares with its bucket's first centre bounds what members share among themselves
            shared = known.select("a", "b", "inter").unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"), "inter"))
            members = (members.drop("inter").join(chosen.select("band", "b"), "band")
                       .join(shared.withColumnRenamed("a", "node"), ["node", "b"], "left").select(*facts))
        members = members.checkpoint()
        fan *= FAN


def _components_of(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, KEY, n_shingles, component_id, node per row of docs. A component has
    one node, also where components share their least doc_id; no words: null."""
    prepare(docs.sparkSession)
    marks = mark(docs).checkpoint()
    classes = (marks.where("n_shingles > 0").groupBy("k1", "k2")
               .agg(F.min("doc_id").alias("class_doc"), F.first("n_shingles").alias("n_shingles"), F.min(F.struct("doc_id", KEY)).alias("rep"),
                    F.first("bands").alias("bands"), F.first("sig").alias("sig"))
               .withColumn("node", F.monotonically_increasing_id()).checkpoint())
    components = _bucket_links(docs, classes, percent)
    if components is None:
        named = classes.select("k1", "k2", F.col("class_doc").alias("component_id"), "node")
    else:
        c = (classes.select("k1", "k2", "node", "class_doc").join(components, "node", "left")
             .select("k1", "k2", "class_doc", F.coalesce("component", "node").alias("component")))
        named = (c.join(c.groupBy("component").agg(F.min("class_doc").alias("component_id")), "component")
                 .select("k1", "k2", "component_id", F.col("component").alias("node")))
    full = (marks.where("n_shingles > 0").select("doc_id", KEY, "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
            .select("doc_id", KEY, "n_shingles", "component_id", "node"))
    return full.unionByName(marks.where("n_shingles = 0").select("doc_id", KEY, "n_shingles", F.col("doc_id").alias("component_id"),
                                                                 F.lit(None).cast("bigint").alias("node")))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable, itself
    included), kept (doc_id = component_id), one row per row of ``docs``.

    Null or empty texts have the empty set and are linked with nothing. A row
    whose doc_id is null takes part; it gets the least non-null doc_id of its
    component, or null (and kept) if there is none. Repeated rows each get a
    row. Other columns are ignored, whatever their names; an empty table gives
    an empty result.
    """
    return (_components_of(docs, percent)
            .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` with one row left per group of near-duplicates: that of
    the least doc_id (ties and repeated rows: any single one of them; rows
    without a doc_id come last). Texts under one doc_id, or without one, are
    told apart: each group keeps its own row. Rows without words are not
    duplicates of anything and all stay."""
    found = _components_of(docs, percent).checkpoint()
    winners = (found.where("n_shingles > 0 and doc_id <=> component_id").groupBy("node", "component_id")
               .agg(F.min(KEY).alias(KEY)).select(F.col("component_id").alias("doc_id"), KEY, F.lit(1).alias("__reel_n")))
    keep = winners.unionByName(found.where("n_shingles = 0").select("doc_id", KEY, F.lit(0).alias("__reel_n")).distinct())
    d = docs.withColumn(KEY, row_key(F.col("text"))).alias("d")
    k = keep.select(F.col("doc_id").alias("__reel_id"), F.col(KEY).alias("__reel_k"), "__reel_n")
    joined = d.join(k, F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("__reel_id")) & (F.col(KEY) == F.col("__reel_k")))
    copy = F.row_number().over(Window.partitionBy("__reel_id", "__reel_k").orderBy(F.lit(0)))
    return (joined.withColumn("__reel_r", F.when(F.col("__reel_n") == 0, 1).otherwise(copy)).where("__reel_r = 1")
            .select(*[F.col(f"d.`{c}`") for c in docs.columns]))
