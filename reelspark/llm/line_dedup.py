"""Line deduplication: whole runs of repeated lines, and content-defined chunks.

``dedup_runs`` and ``drop_repeated_lines`` remove every run of whole lines that
stands, byte for byte, in a document with a smaller doc_id: runs of several
lines with at least ``MIN_WORDS`` words, and single lines of ``LONG_LINE`` words
or more. A run is the union of its windows: for every line the shortest window
of two lines or more with ``MIN_WORDS`` words that starts there, and the
shortest that ends there. Both depend on nothing but the lines inside, so a
copied run has the same windows wherever it stands, and each of its lines is in
one of them; it is found whole without comparing documents. (Boundaries that a
hash chooses cannot do this: a run between two boundaries shares no chunk with
its copy. See README.)

``dedup_lines`` is the coarser form by chunks. A text's lines are cut into chunks where a rolling hash over the last two line
hashes says so, so that a passage put into another document is cut alike from
its first own boundary on, whatever stands before it. A line of
``LONG_LINE`` words or more is a chunk by itself. A chunk of several lines with
at least ``MIN_WORDS`` words, or of one long line, is removed where a document
with a smaller doc_id holds the same chunk, byte for byte; the first document
keeps it. Shorter chunks stay: they repeat by chance.

Only hashes are shuffled to find repeated windows or chunks. The bytes of those
that may be repeated follow (a bitmap of fixed size tells which; when it fills
up, more bytes travel and nothing else changes) and are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import KEY, binary_values, broadcast_if, prepare, release, released, row_key

LONG_LINE = 20
MIN_WORDS = 10
#: A chunk of short lines ends on average after this many lines (a power of two).
MEAN_LINES = 2
FILTER_BITS = 1 << 24
_BITS_PER_LONG = 63

_WINDOWS = "o bigint, h1 bigint, h2 bigint"
_CHUNKS = f"doc_id bigint, {KEY} bigint, k int, h1 bigint, h2 bigint"


def chunks(text: bytes) -> list[tuple[int, int, int]]:
    """(first line, end line, words) of each chunk of a text's lines."""
    out, start, words, last = [], 0, 0, 0
    lines = text.split(b"\n")
    for i, line in enumerate(lines):
        n = len(line.split())
        h = xxhash.xxh3_64_intdigest(line)
        if n >= LONG_LINE:
            if i > start:
                out.append((start, i, words))
            out.append((i, i + 1, n))
            start, words = i + 1, 0
        else:
            words += n
            if ((h * 0x9E3779B97F4A7C15 + last * 0xC2B2AE3D27D4EB4F) >> 40) % MEAN_LINES == 0:
                out.append((start, i + 1, words))
                start, words = i + 1, 0
        last = h
    if start < len(lines):
        out.append((start, len(lines), words))
    return out


def removable(first: int, end: int, words: int) -> bool:
    return words >= (MIN_WORDS if end - first > 1 else LONG_LINE)


def windows(text: bytes) -> list[tuple[int, int, bytes, bytes]]:
    """(first line, end line, digest, content) of each window of a text's lines.

    The content is the window's bytes. A window that starts or ends with a line
    without words is the window without that line, and the line: its content is
    that window's digest and the line's bytes, so that long stretches of empty
    lines cost no more than their lines. Two windows with a digest in common
    are equal if their contents are, and so on down to the bytes.
    """
    lines = text.split(b"\n")
    words = [len(line.split()) for line in lines]
    ends, at = [], 0  # of every line in text
    for line in lines:
        at += len(line)
        ends.append(at)
        at += 1
    found: dict[tuple[int, int], tuple[bytes, bytes]] = {}

    def add(lo: int, hi: int) -> None:
        if (lo, hi) in found:
            return
        if hi - lo > 2 and not words[lo]:
            content = b"F" + found[lo + 1, hi][0] + lines[lo]
        elif hi - lo > 2 and not words[hi - 1]:
            content = b"B" + found[lo, hi - 1][0] + lines[hi - 1]
        else:
            content = b"R" + text[ends[lo] - len(lines[lo]):ends[hi - 1]]
        found[lo, hi] = xxhash.xxh3_128_digest(content), content

    for i, n in enumerate(words):
        if n >= LONG_LINE:
            add(i, i + 1)
    starts, hi, total = [], 0, 0  # words of lines[lo:hi]
    for lo in range(len(lines) - 1):
        while hi < len(lines) and (total < MIN_WORDS or hi < lo + 2):
            total += words[hi]
            hi += 1
        if total < MIN_WORDS:
            break
        starts.append((lo, hi))
        total -= words[lo]
    for span in reversed(starts):
        add(*span)
    lo, total = 0, 0
    for hi in range(1, len(lines) + 1):
        total += words[hi - 1]
        while hi - lo > 2 and total - words[lo] >= MIN_WORDS:
            total -= words[lo]
            lo += 1
        if hi - lo >= 2 and total >= MIN_WORDS:
            add(lo, hi)
    return [(lo, hi, *x) for (lo, hi), x in found.items()]


def _repeatable(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(doc_id, KEY, k, h1, h2, chunk) of every chunk long enough."""
    for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column(KEY).to_pylist(),
                              binary_values(batch.column("text")), strict=True):
        lines = text.split(b"\n")
        for k, (lo, hi, words) in enumerate(chunks(text)):
            if removable(lo, hi, words):
                chunk = b"\n".join(lines[lo:hi])
                h1, h2 = np.frombuffer(xxhash.xxh3_128_digest(chunk), np.int64).tolist()
                yield doc, key, k, h1, h2, chunk


def _table(rows: list[tuple], chunk: bool) -> pa.RecordBatch:
    names = ["doc_id", KEY, "k", "h1", "h2"] + ["chunk"] * chunk
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * chunk
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=names)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        yield _table(list(_repeatable(batch)), chunk=False)


def _bytes_of(packed: dict[int, int]):
    """Chunks whose hash the bitmap has, with their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            rows, size = [], 0
            for row in _repeatable(batch):
                b = row[3] & (FILTER_BITS - 1)
                if packed.get(b // _BITS_PER_LONG, 0) >> (b % _BITS_PER_LONG) & 1:
                    rows.append(row)
                    size += len(row[5])
                    if size > 1 << 24:
                        yield _table(rows, chunk=True)
                        rows, size = [], 0
            yield _table(rows, chunk=True)
    return run


def _order_of(doc: int | None) -> int:
    return (1 << 63) - 1 if doc is None else doc


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, h1, h2) of a document's distinct windows."""
    for batch in released(batches):
        orders, digests = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), binary_values(batch.column("text")), strict=True):
            found = {digest for _, _, digest, _ in windows(text)}
            digests.extend(found)
            orders.append((_order_of(doc), len(found)))
        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        o = np.repeat(np.array([x for x, _ in orders], np.int64), [n for _, n in orders])
        yield pa.RecordBatch.from_arrays([pa.array(o), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["o", "h1", "h2"])


def _candidates(packed: dict[int, int], batch: pa.RecordBatch) -> Iterator[tuple]:
    """(doc_id, KEY, lo, hi, h1, h2, window) of windows whose hash the bitmap has."""
    for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column(KEY).to_pylist(),
                              binary_values(batch.column("text")), strict=True):
        for lo, hi, digest, window in windows(text):
            h1, h2 = np.frombuffer(digest, np.int64).tolist()
            b = h1 & (FILTER_BITS - 1)
            if packed.get(b // _BITS_PER_LONG, 0) >> (b % _BITS_PER_LONG) & 1:
                yield doc, key, lo, hi, h1, h2, window


def _window_bytes(packed: dict[int, int]):
    """(order, h1, h2, window), each window of a document once."""
    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["o", "h1", "h2", "window"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            rows, size = set(), 0
            for doc, _, _, _, h1, h2, window in _candidates(packed, batch):
                row = (_order_of(doc), h1, h2, window)
                if row not in rows:
                    rows.add(row)
                    size += len(window)
                    if size > 1 << 22:
                        yield table(list(rows))
                        rows, size = set(), 0
            yield table(list(rows))
    return run


def _window_places(packed: dict[int, int]):
    """(doc_id, KEY, lo, hi, h1, h2)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        for batch in released(batches):
            rows = [row[:6] for row in _candidates(packed, batch)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             names=["doc_id", KEY, "lo", "hi", "h1", "h2"])
    return run


def _without_runs(texts: pa.Array, removed: pa.Array) -> pa.Array:
    """Texts without the lines of the windows in ``removed``; (text, lines, lines removed, runs removed)."""
    out = []
    for text, gone in zip(texts.to_pylist(), removed.to_pylist(), strict=True):
        raw = (text or "").encode()
        if not gone:
            out.append((text, raw.count(b"\n") + 1 if raw else 0, 0, 0))
            continue
        lines, kept, at, runs, end = raw.split(b"\n"), [], 0, 0, -1
        for lo, hi in sorted((g["lo"], g["hi"]) for g in gone):
            runs += lo > end  # windows that touch are one run
            kept += lines[at:lo]
            at, end = max(at, hi), max(end, hi)
        kept += lines[at:]
        out.append((b"\n".join(kept).decode(), len(lines), len(lines) - len(kept), runs))
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    release()
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                                      names=["text", "n_lines", "n_removed_lines", "n_removed_chunks"])


def _without(texts: pa.Array, removed: pa.Array) -> pa.Array:
    """Texts without the chunks numbered in ``removed``; (text, lines, lines removed, chunks removed)."""
    out = []
    for text, gone in zip(texts.to_pylist(), removed.to_pylist(), strict=True):
        raw = (text or "").encode()
        if not gone:
            out.append((text, raw.count(b"\n") + 1 if raw else 0, 0, 0))
            continue
        lines, gone = raw.split(b"\n"), set(gone)
        spans = chunks(raw)
        kept = [line for k, (lo, hi, _) in enumerate(spans) if k not in gone for line in lines[lo:hi]]
        out.append((b"\n".join(kept).decode(), len(lines), len(lines) - len(kept), len(gone)))
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    release()
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                                      names=["text", "n_lines", "n_removed_lines", "n_removed_chunks"])


def _order() -> Column:
    """Documents in order of doc_id; rows without one come last, as one document."""
    return F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))


def _bitmap(first: DataFrame) -> dict[int, int]:
    """The bits of all h1; at most FILTER_BITS / 63 rows, whatever the corpus."""
    bit = F.pmod(F.col("h1"), F.lit(FILTER_BITS))
    return {r["w"]: r["bits"] for r in
            first.select((bit / _BITS_PER_LONG).cast("bigint").alias("w"), (bit % _BITS_PER_LONG).cast("int").alias("b")).distinct()
            .groupBy("w").agg(F.sum(F.expr("shiftleft(1L, b)")).alias("bits")).toLocalIterator()}


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, KEY, gone): per document the windows (lo, hi) an earlier one has."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key(F.col("text")).alias(KEY), "text")
    repeated = F.col("first") < F.col("last")
    hashed = (narrow.mapInArrow(_window_hashes, _WINDOWS).groupBy("h1", "h2").agg(F.min("o").alias("first"), F.max("o").alias("last"))
              .where(repeated).select("h1").checkpoint())
    packed = _bitmap(hashed)
    # equal bytes are grouped, so that a common window is combined before the shuffle; a hash with two windows names neither
    first = (narrow.mapInArrow(_window_bytes(packed), _WINDOWS + ", window binary")
             .groupBy("h1", "h2", "window").agg(F.min("o").alias("first"), F.max("o").alias("last"))
             .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
             .where(repeated & (F.col("n") == 1)).select("h1", "h2", "first").checkpoint())
    first = broadcast_if(first, first.count())
    return (narrow.mapInArrow(_window_places(packed), f"doc_id bigint, {KEY} bigint, lo int, hi int, h1 bigint, h2 bigint")
            .join(first, ["h1", "h2"]).where(_order() > F.col("first"))
            .groupBy("doc_id", KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("gone")))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, KEY, gone): per document the numbers of the chunks to remove."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key(F.col("text")).alias(KEY), "text")
    found = narrow.mapInArrow(_hashes, _CHUNKS)
    first = (found.groupBy("h1", "h2").agg(F.min(_order()).alias("first"), F.max(_order()).alias("last"))
             .where("first < last").select("h1", "h2", "first").checkpoint())
    packed = _bitmap(first)
    copies = (narrow.mapInArrow(_bytes_of(packed), _CHUNKS + ", chunk binary").join(first, ["h1", "h2"])
              .withColumn("is_first", _order() == F.col("first")).checkpoint())
    original = (copies.where("is_first").select("h1", "h2", F.col("chunk").alias("original")).distinct())
    return (copies.where("not is_first").join(original, ["h1", "h2"]).where("chunk = original")
            .groupBy("doc_id", KEY).agg(F.collect_set("k").alias("gone")))


def _rewritten(docs: DataFrame, runs: bool) -> DataFrame:
    """``docs`` with __reel_new: the new text and the counts of what went."""
    prepare(docs.sparkSession)
    gone = (repeated_windows if runs else repeated_chunks)(docs).select(F.col("doc_id").alias("__reel_id"), F.col(KEY).alias("__reel_k"), F.col("gone").alias("__reel_gone"))
    d = docs.withColumn(KEY, row_key(F.col("text")))
    joined = d.join(gone, d["doc_id"].cast("bigint").eqNullSafe(gone["__reel_id"]) & (d[KEY] == gone["__reel_k"]), "left")
    rewrite = F.arrow_udf(_without_runs if runs else _without, "struct<text:string,n_lines:bigint,n_removed_lines:bigint,n_removed_chunks:bigint>")
    return joined.withColumn("__reel_new", rewrite(F.col("text"), F.col("__reel_gone")))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns text (deduplicated), n_lines, n_removed_lines
    and n_removed_chunks added or replaced.

    Documents are told apart by doc_id: repeated rows and versions of one
    document do not remove each other's chunks, and rows without a doc_id come
    after all others. A null text stays null, an empty one empty; a document
    whose chunks all go has the text ''. Input columns keep their values,
    whatever their names, except the four above; an empty table gives an empty
    result.
    """
    return _counted(docs, runs=False)


def dedup_runs(docs: DataFrame) -> DataFrame:
    """As ``dedup_lines``, but every repeated run of whole lines goes, wherever
    chunks end; n_removed_chunks counts the runs. Time and memory grow with a
    text's size, whatever its lines hold."""
    return _counted(docs, runs=True)


def _counted(docs: DataFrame, runs: bool) -> DataFrame:
    new = ("text", "n_lines", "n_removed_lines", "n_removed_chunks")
    return _rewritten(docs, runs).select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *[F.col(f"__reel_new.{c}").alias(c) for c in new])


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated runs of lines removed from text (n_chars, if there is
    such a column, follows); rows of which nothing is left go, other columns
    and rows stay as they are."""
    changed = F.col("__reel_new.n_removed_chunks") > 0
    text = F.col("__reel_new.text")
    out = {"text": text, "n_chars": F.when(changed, F.length(text))}
    kept = _rewritten(docs, runs=True).where(~changed | (F.trim(text) != ""))
    return kept.select(*[(F.coalesce(out[c], F.col(c)) if c == "n_chars" else out[c]).cast(docs.schema[c].dataType).alias(c) if c in out
                         else F.col(f"`{c}`") for c in docs.columns])
