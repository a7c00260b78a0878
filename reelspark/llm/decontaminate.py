"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits (A-Z lower-cased) and any non-ASCII
characters. A window is ten consecutive words of a benchmark item; an item of
one to nine words is one window as a whole. A document keeps the minimum
6-gram hash of every 5 consecutive 6-grams. Ten words hold exactly five
6-grams, so every span shared with a window holds the window's own minimum at
the same place: joining the fingerprints finds every occurrence. Each hit is
then extended to its whole window and compared word by word, and overlapping
windows merge into the maximal shared spans.

Documents are read once. A bitmap of fixed size (``FILTER_BITS``), filled from
the benchmark's fingerprints, says which positions can have a partner; only
those leave the scan, with the words around them. A bitmap that fills up under
a huge benchmark costs rows, never results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from reelspark.llm.common import KEY, binary_values, hash_words, ngram_hashes, prepare, released, row_key, same_row, slices

WINDOW = 10
GRAM = 6
FILTER_BITS = 1 << 22
_BITS_PER_LONG = 63

#: Separators become spaces, A-Z lower case; every other byte stays.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def item_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def winnow_minima(grams: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` hashes."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = grams[:n].copy()
    for j in range(1, width):
        np.minimum(out, grams[j:j + n], out=out)
    return out


_ITEM_WINDOWS = "item_id string, words array<string>, h bigint, o int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window of an item: its words, and the hash and place of its fingerprint."""
    width = WINDOW - GRAM + 1
    for batch in released(batches):
        ids, texts = batch.column("item_id").to_pylist(), binary_values(batch.column("text"))
        for lo, hi in slices([len(t) for t in texts], 1 << 18):
            out: dict[str, list] = {"item_id": [], "words": [], "h": [], "o": []}
            for item, text in zip(ids[lo:hi], texts[lo:hi], strict=True):
                words = item_words(text)
                if not words:
                    continue
                n = min(len(words), WINDOW)
                grams = ngram_hashes(hash_words(words), GRAM if n == WINDOW else n)
                for s in range(len(words) - n + 1):
                    o = int(np.argmin(grams[s:s + width])) if n == WINDOW else 0
                    out["item_id"].append(item)
                    out["words"].append([w.decode() for w in words[s:s + n]])
                    out["h"].append(int(grams[s + o].view(np.int64)))
                    out["o"].append(o)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["item_id"], pa.string()), pa.array(out["words"], pa.list_(pa.string())),
                 pa.array(out["h"], pa.int64()), pa.array(out["o"], pa.int32())], names=list(out))


_SCANNED = (f"doc_id bigint, {KEY} bigint, n_words bigint, "
            "found array<struct<pos:int,before:int,h:bigint,words:array<string>>>")
_FOUND = pa.list_(pa.struct([("pos", pa.int32()), ("before", pa.int32()), ("h", pa.int64()), ("words", pa.list_(pa.string()))]))


def _fingerprints(words: np.ndarray, starts: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """Positions of winnowed 6-grams that pass the bitmap, over documents laid end to end."""
    grams, width = ngram_hashes(words, GRAM), WINDOW - GRAM + 1
    at = np.flatnonzero(maybe[(grams & np.uint64(FILTER_BITS - 1)).astype(np.int64)])
    if not len(at):
        return at
    minima = winnow_minima(grams, width)
    doc = np.searchsorted(starts, np.arange(len(minima)), side="right")
    whole = doc == np.searchsorted(starts, np.arange(len(minima)) + WINDOW - 1, side="right")
    chosen = np.zeros(len(at), bool)
    for j in range(width):
        w = at - j
        ok = (w >= 0) & (w < len(minima))
        w = np.where(ok, w, 0)
        chosen |= ok & whole[w] & (minima[w] == grams[at])
    return at[chosen]


def _scan(packed: list[int], short: list[int]):
    """Per document: number of words, and fingerprints that may be the benchmark's, with their surroundings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = np.array(packed, np.int64)
        maybe = ((longs[:, None] >> np.arange(_BITS_PER_LONG)) & 1).astype(bool).ravel()[:FILTER_BITS]
        for batch in released(batches):
            texts = binary_values(batch.column("text"))
            for lo, hi in slices([len(t) // 6 for t in texts], 1 << 18):
                split = [item_words(t) for t in texts[lo:hi]]
                counts = np.array([len(w) for w in split], np.int64)
                starts = np.zeros(len(split) + 1, np.int64)
                np.cumsum(counts, out=starts[1:])
                every = [w for words in split for w in words]
                hashes = hash_words(every)
                places = [(p, GRAM, h) for p, h in _places(hashes, starts[:-1], maybe)]
                for n in short:
                    grams = ngram_hashes(hashes, n)
                    at = np.flatnonzero(maybe[(grams & np.uint64(FILTER_BITS - 1)).astype(np.int64)])
                    ends = starts[np.searchsorted(starts, at, side="right")]
                    at = at[at + n <= ends]
                    places += [(int(p), n, int(grams[p].view(np.int64))) for p in at]
                found: list[list] = [[] for _ in split]
                for p, n, h in places:
                    d = int(np.searchsorted(starts, p, side="right")) - 1
                    left, right = (max(p - (WINDOW - GRAM), starts[d]), min(p + WINDOW, starts[d + 1])) if n == GRAM else (p, p + n)
                    found[d].append({"pos": int(p - starts[d]), "before": int(p - left), "h": h,
                                     "words": [w.decode() for w in every[left:right]]})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column(KEY).slice(lo, hi - lo), pa.array(counts),
                     pa.array(found, _FOUND)], names=["doc_id", KEY, "n_words", "found"])

    def _places(hashes: np.ndarray, starts: np.ndarray, maybe: np.ndarray):
        grams = ngram_hashes(hashes, GRAM)
        for p in _fingerprints(hashes, starts, maybe):
            yield int(p), int(grams[p].view(np.int64))
    return run


def contamination(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, spans, items): per row of ``docs`` (doc_id, KEY, n_words);
    per shared window (doc_id, KEY, start, length in words); per document and
    item with an occurring window (doc_id, KEY, item_id)."""
    spark = docs.sparkSession
    prepare(spark)
    windows = (benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
               .mapInArrow(_windows, _ITEM_WINDOWS).checkpoint())
    distinct = windows.select("words", "h", "o").distinct()
    bit = F.pmod(F.col("h"), F.lit(FILTER_BITS))
    longs = {r["w"]: r["bits"] for r in  # at most FILTER_BITS / 63 rows, whatever the benchmark's size
             windows.select((bit / _BITS_PER_LONG).cast("bigint").alias("w"), (bit % _BITS_PER_LONG).cast("int").alias("b")).distinct()
             .groupBy("w").agg(F.sum(F.expr("shiftleft(1L, b)")).alias("bits")).collect()}
    packed = [longs.get(i, 0) for i in range(FILTER_BITS // _BITS_PER_LONG + 1)]
    short = sorted(r[0] for r in windows.select(F.size("words")).where(F.size("words") < WINDOW).distinct().collect())
    scanned = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key(F.col("text")).alias(KEY), "text")
               .mapInArrow(_scan(packed, short), _SCANNED).checkpoint())
    hits = scanned.select("doc_id", KEY, F.explode("found").alias("f")).select("doc_id", KEY, "f.*").distinct()
    w = distinct.select(F.col("words").alias("window"), "h", "o")
    whole = (hits.join(w, "h").where("before >= o and slice(words, before - o + 1, size(window)) = window")
             .select("doc_id", KEY, (F.col("pos") - F.col("o")).alias("start"), F.size("window").alias("length"), "window")
             .distinct().checkpoint())
    owners = windows.select(F.col("words").alias("window"), "item_id").distinct()
    items = whole.select("doc_id", KEY, "window").distinct().join(owners, "window").select("doc_id", KEY, "item_id").distinct()
    return scanned.select("doc_id", KEY, "n_words"), whole.select("doc_id", KEY, "start", "length").distinct(), items


def covered_words(spans: DataFrame) -> DataFrame:
    """(doc_id, KEY, n_hit): words inside at least one span."""
    before = Window.partitionBy("doc_id", KEY).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    reached = F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0)))
    return (spans.withColumn("n", F.greatest(end - reached, F.lit(0))).groupBy("doc_id", KEY)
            .agg(F.sum("n").cast("bigint").alias("n_hit")))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per row of ``docs``.

    Null or empty texts have no words and no hits; a null doc_id keeps its row;
    repeated rows each get one. An item whose item_id is null takes part in
    n_hit and counts as an item but has no place in items_sha256. Null and
    empty items have no windows. Other columns are ignored. Empty tables give
    an empty result (documents) or no hits (benchmark).
    """
    rows, spans, items = contamination(docs, benchmark)
    hit = covered_words(spans)
    named = (items.groupBy("doc_id", KEY)
             .agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("ids")))
    found = hit.join(named, same_row(hit, named)).select(hit["doc_id"], hit[KEY], "n_hit", "n_items", "ids")
    return (rows.join(found, same_row(rows, found), "left")
            .select(rows["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).cast(T.LongType()).alias("n_hit"),
                    F.coalesce("n_items", F.lit(0)).cast(T.LongType()).alias("n_items"),
                    F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without any benchmark window; null and empty texts stay."""
    _, spans, _ = contamination(docs, benchmark)
    bad = spans.select(F.col("doc_id").alias("__reel_id"), F.col(KEY).alias("__reel_k")).distinct()
    d = docs.withColumn(KEY, row_key(F.col("text")))
    return (d.join(bad, d["doc_id"].cast("bigint").eqNullSafe(bad["__reel_id"]) & (d[KEY] == bad["__reel_k"]), "left_anti")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
