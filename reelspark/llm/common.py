"""Helpers shared by the corpus operators: words, hashes, stable row keys."""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.session import checkpoint_dir, ship_package

#: Names of helper columns; no input column may start with this prefix.
PREFIX = "__reel_"
KEY = PREFIX + "key"

_LIBC = ctypes.CDLL(None) if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim") else None

#: Entries a worker keeps in a word cache before it starts afresh (memory bound, results do not depend on it).
CACHE_ENTRIES = 1 << 16


#: Largest Arrow batch handed to a Python worker. A worker holds a few times as much.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, package files and batch size every operator relies on.

    The session's limit on Arrow batches is lowered to BATCH_BYTES if it is
    higher: texts differ in length by orders of magnitude, so a number of rows
    alone bounds nothing.
    """
    checkpoint_dir(spark)
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", spark.conf.get(key).lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def row_key(text: Column) -> Column:
    """Hash of a text. With doc_id it names a row: rows equal in both are
    interchangeable, and unlike a running number it is the same whenever a
    lost partition is computed again."""
    return F.xxhash64(text)


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Null-safe equality on (doc_id, KEY)."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & left[KEY].eqNullSafe(right[KEY])


#: Most rows of a broadcast table of a few fixed-width columns.
BROADCAST_ROWS = 1 << 18


def broadcast_if(narrow: DataFrame, rows: int) -> DataFrame:
    """``narrow`` with a broadcast hint if it has at most BROADCAST_ROWS rows
    (``rows`` is its counted size or an upper bound); beyond that the join is
    shuffled."""
    return F.broadcast(narrow) if rows <= BROADCAST_ROWS else narrow


#: Rows of a few fixed-width columns that one partition of a checkpoint holds at least, where there are so many.
NARROW_ROWS = 1 << 18


def gathered(narrow: DataFrame, rows: int) -> DataFrame:
    """``narrow`` in fewer partitions if its ``rows`` (an estimate) would leave
    most of them nearly empty; as many as the cluster has cores stay. A
    checkpoint writes a file for each partition."""
    return narrow.coalesce(max(narrow.sparkSession.sparkContext.defaultParallelism, -(-rows // NARROW_ROWS)))


def release() -> None:
    """Hand memory that is free inside this worker back to the system. Workers
    live through many stages, and what one stage's peak leaves would add up."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with a ``release`` after each."""
    for batch in batches:
        yield batch
        del batch
        release()


class WordHash(dict):
    """word (bytes) -> 64-bit hash, computed once per word while it stays cached."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = WordHash()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def _odd(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit multipliers from a seed."""
    return np.array([xxhash.xxh3_64_intdigest(b"%d:%d" % (seed, i)) | 1 for i in range(n)], dtype=np.uint64)


_MULTIPLIERS = _odd(11, 64)


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i+k] for every i; empty if there are fewer than k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k)) * _MULTIPLIERS[63]
    for j in range(k):
        out += words[j:j + n] * _MULTIPLIERS[j]
    out ^= out >> np.uint64(31)
    out *= _MULTIPLIERS[62]
    out ^= out >> np.uint64(29)
    return out


def binary_values(column: pa.Array) -> list[bytes]:
    """A string column as a list of UTF-8 byte strings, null as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def list_array(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def slices(sizes: list[int], limit: int):
    """Consecutive index ranges whose sizes add up to about limit; one large element makes a range of its own."""
    start = total = 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)
