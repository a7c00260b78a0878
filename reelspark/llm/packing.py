"""Best-fit packing with Martello-Toth dominance reduction.

Documents become token pieces of at most ``capacity`` tokens. Packing needs
only how many pieces there are of each length, a table of at most ``capacity``
rows whatever the corpus: the driver plans on that histogram, first fixing the
sets that the dominance rules prove to be part of some best packing, then
placing the rest by best fit, longest first. The plan is a list of slots
(length, range of ranks, first sequence, offset). Every piece gets its rank
among the pieces of its length and looks its slot up, in parallel.

Equal lengths are interchangeable, so a rule or a placement is applied to as
many pieces at once as it holds for; the plan has O(capacity) steps.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from reelspark.llm.common import CACHE_ENTRIES, KEY, binary_values, prepare, released, row_key, slices
from reelspark.session import shuffle_partitions

CAPACITY = 2048
END_ID = 0
#: Runs of characters a worker keeps the ids of; results do not depend on it.
RUNS = 1 << 19

_PIECES = f"doc_id bigint, {KEY} bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


#: Characters whose normal form and lower case do not depend on their neighbours, and white space.
_PLAIN = re.compile(r"[\x09-\x0d\x20-\x7e\u00a1-\u012f\u0131-\u024f]*")
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_KIND = np.array([_SPACE if chr(c).isspace() else _LETTER if chr(c).isalpha() else _NUMBER if unicodedata.category(chr(c))[0] == "N" else _OTHER
                  for c in range(0x250)], np.uint8)
#: Running powers for the hash of a run, and the inverse powers that shift it to the run's start.
_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(97).integers(1, 1 << 63, 0x250, np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None and "<|" not in text


def runs_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a plain lower-cased text: letters, single
    numbers, other characters; an apostrophe that starts a run takes the English
    endings 's 't 'm 'd 're 've 'll with it."""
    n = len(codes)
    kind = _KIND[codes]
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    padded = np.append(codes, np.zeros(3, codes.dtype))
    at = np.flatnonzero((codes == ord("'")) & start)
    one, two = padded[at + 1], padded[at + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    size = np.where(short, 2, 3)[short | long]
    at = at[short | long]
    start[at + 1] = False
    after = at + size
    after = after[after < n]
    start[after] = True
    starts = np.flatnonzero(start & (kind != _SPACE))
    # a run ends where the next run or white space starts
    edge = np.append(np.flatnonzero(start), n)
    return starts, edge[np.searchsorted(edge, starts, side="right")]


def _same_runs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> bool:
    """Whether every run equals run number ``first`` of its own, character by character."""
    size = ends - starts
    if (size != size[first]).any():
        return False
    total = np.cumsum(size)
    at = np.arange(total[-1] if len(total) else 0) + np.repeat(starts - total + size, size)
    return bool((codes[at] == codes[at + np.repeat(starts[first] - starts, size)]).all())


class _RunIds:
    """Token ids by run, in caches of bounded size.

    The tokenizer puts a text into normal form and lower case and cuts it into
    runs. For plain Latin texts this cut is repeated on whole blocks of texts.
    Within a block runs are grouped by a running hash and compared character by
    character with the first of their group; across blocks a run is known by
    the 128-bit hash of its bytes. Only runs not met before are encoded, many
    at a time: the vocabulary marks the last token of each run. Other texts,
    and a block in which the running hash takes two runs for one, are cut at
    white space first, which no run crosses, and their odd words encoded as
    they stand.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.odd: dict[str, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, np.uint64)  # low halves of the hashes of known runs, sorted, with the high halves and the runs' numbers
        self.checks = np.empty(0, np.uint64)
        self.numbers = np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)
        self.first = np.zeros(1, np.int64)  # run k's ids are flat[first[k]:first[k + 1]]

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, hashes: np.ndarray, checks: np.ndarray, runs: list[str]) -> None:
        """``hashes``: sorted, none known."""
        ids = self._encode(" ".join(runs))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(runs) or ends[-1] != len(ids):
            parts = [self._encode(run) for run in runs]
            ids, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        at = np.searchsorted(self.keys, hashes)
        self.numbers = np.insert(self.numbers, at, np.arange(len(runs)) + len(self.first) - 1)
        self.keys, self.checks = np.insert(self.keys, at, hashes), np.insert(self.checks, at, checks)
        self.first = np.concatenate((self.first, ends + len(self.flat)))
        self.flat = np.concatenate((self.flat, ids))

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts."""
        lower = [t.lower() for t in texts]
        joined = " ".join(lower)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts, ends = runs_of(codes)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODES[codes] * _powers(_BASE, len(codes)), dtype=np.uint64))) if len(codes) else np.zeros(1, np.uint64)
        inverse = _powers(pow(_BASE, -1, 1 << 64), len(codes) + 1)
        hashes = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
        _, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        if not _same_runs(codes, starts, ends, where[which]):
            return [self._by_words(t) for t in texts]
        runs = [joined[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        halves = np.frombuffer(b"".join([xxhash.xxh3_128_digest(r.encode()) for r in runs]), "<u8").reshape(-1, 2)
        order = np.argsort(halves[:, 0], kind="stable")
        distinct, checks = halves[order, 0], halves[order, 1]
        if len(self.keys) + len(distinct) > RUNS:
            self._clear()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == distinct[at < len(self.keys)]
        if (distinct[1:] == distinct[:-1]).any() or (self.checks[at[known]] != checks[known]).any():
            return [self._by_words(t) for t in texts]
        new = np.flatnonzero(~known)
        for some in np.array_split(new, -(-len(new) // (1 << 14))) if len(new) else ():
            self._learn(distinct[some], checks[some], [runs[order[i]] for i in some])
        place = np.empty(len(order), np.int64)  # of each group in sorted order
        place[order] = np.arange(len(order))
        which = place[which]
        run = self.numbers[np.searchsorted(self.keys, distinct)][which]
        length = self.first[run + 1] - self.first[run]
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(length)))
        ids = self.flat[np.repeat(self.first[run] - total[:-1], length) + np.arange(total[-1])]
        text_ends = np.cumsum([len(t) + 1 for t in lower])
        bounds = total[np.searchsorted(starts, text_ends)].tolist()
        return [ids[a:b] for a, b in zip([0, *bounds], bounds, strict=False)]

    def _by_words(self, text: str) -> np.ndarray:
        """Ids of any text, word by word."""
        out = [np.empty(0, np.uint32)]
        for raw in text.encode().split():
            word = raw.decode()
            if word not in self.odd:
                if len(self.odd) >= CACHE_ENTRIES:
                    self.odd.clear()
                self.odd[word] = self._encode(word)
            out.append(self.odd[word])
        return np.concatenate(out)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        easy = [i for i, t in enumerate(texts) if _plain(t)]
        found = dict(zip(easy, self._block([texts[i] for i in easy]), strict=True)) if easy else {}
        return [found[i] if i in found else self._by_words(t) for i, t in enumerate(texts)]


@lru_cache(maxsize=2)
def _run_ids(path: str) -> _RunIds:
    return _RunIds(path)


def token_ids(texts: list[bytes], path: str) -> list[bytes]:
    """Token ids of each text, END_ID behind, packed as little-endian 32-bit numbers."""
    end = END_ID.to_bytes(4, "little")
    return [ids.astype("<u4").tobytes() + end for ids in _run_ids(path).ids([t.decode() for t in texts])]


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            texts = binary_values(batch.column("text"))
            ids, keys = batch.column("doc_id").to_pylist(), batch.column(KEY).to_pylist()
            for lo, hi in slices([len(t) for t in texts], 1 << 20):
                rows: list[tuple] = []
                for doc, key, packed in zip(ids[lo:hi], keys[lo:hi], token_ids(texts[lo:hi], path), strict=True):
                    for piece, at in enumerate(range(0, len(packed), 4 * capacity)):
                        part = packed[at:at + 4 * capacity]
                        rows.append((doc, key, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True),
                     (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", KEY, "piece", "start", "length", "ids_crc32"])
    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, KEY, piece, start, length, ids_crc32: one row per piece."""
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key(F.coalesce(F.col("text"), F.lit(""))).alias(KEY), "text")
            .mapInArrow(_cut(tokenizer_path, capacity), _PIECES))


class _Sizes:
    """Multiset of sizes, in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            del self.order[bisect_left(self.order, size)]

    def largest(self, limit: int, without: Counter) -> int:
        """Largest size up to limit that is left after ``without``; 0 if none."""
        for i in range(bisect_right(self.order, limit) - 1, -1, -1):
            if self.counts[self.order[i]] > without[self.order[i]]:
                return self.order[i]
        return 0

    def smallest(self, n: int, without: Counter) -> list[int]:
        out: list[int] = []
        for s in self.order:
            out += [s] * min(n - len(out), self.counts[s] - without[s])
            if len(out) == n:
                break
        return out

    def best_pair(self, limit: int, without: Counter) -> tuple[int, int]:
        """Two sizes a >= b with the largest a + b <= limit, a as large as possible; (0, 0) if none."""
        free = [s for s in self.order if self.counts[s] > without[s]]
        lo, hi, best = 0, len(free) - 1, (0, 0)
        while lo <= hi:
            a, b = free[hi], free[lo]
            if a + b > limit:
                hi -= 1
                continue
            if (lo < hi or self.counts[a] - without[a] > 1) and a + b > sum(best):
                best = (a, b)
            lo += 1
        return best


def _dominating(sizes: _Sizes, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with j that dominates every other set with j, or None if the rules name none."""
    own = Counter({j: 1})
    room = capacity - j
    least = sizes.smallest(3, own)
    fits = sum(sum(least[:n]) <= room for n in range(1, len(least) + 1))
    if not fits:
        return (j,)
    partner = sizes.largest(room, own)
    if fits == 1 or partner == room:
        return j, partner
    if fits > 2:
        return None
    a, b = sizes.best_pair(room, own)
    if partner >= a + b:
        return j, partner
    if partner == a:
        # another pair could only beat (a, b) with both members between b and a
        between: list[int] = []
        for s in sizes.order[bisect_right(sizes.order, b):]:
            between += [s] * min(2, sizes.counts[s] - own[s] - (s == a))
            if s >= a or len(between) >= 2:
                break
        if len(between) < 2 or sum(between[:2]) > room:
            return j, a, b
    return None


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first sequence, per sequence, offset).

    The pieces of a length with ranks first..end-1 go, ``per sequence`` at a
    time, into sequences counted from ``first sequence``, one behind another
    from ``offset``.
    """
    sizes = _Sizes(histogram)
    used: Counter = Counter()
    slots: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def place(size: int, n_sequences: int, first: int, per: int, offset: int) -> None:
        rank = used[size]
        used[size] += n_sequences * per
        slots.append((size, rank, used[size], first, per, offset))

    def fix(group: tuple[int, ...]) -> None:
        nonlocal sequences
        need = Counter(group)
        times = min(sizes.counts[s] // n for s, n in need.items())
        offset = 0
        for s, n in need.items():
            place(s, times, sequences, n, offset)
            offset += s * n
            sizes.take(s, times * n)
        sequences += times

    kept: list[tuple[int, int]] = []  # pieces no rule decides on, left for best fit
    j = sizes.largest(capacity, Counter())
    while j:
        group = _dominating(sizes, j, capacity)
        if group:
            fix(group)
            j = j if j in sizes.counts else sizes.largest(j, Counter())
        else:
            j = sizes.largest(j - 1, Counter())
    kept = [(s, sizes.counts[s]) for s in reversed(sizes.order)]

    # Best fit, longest first. Open groups of equal sequences: room -> [(first sequence, how many)].
    open_groups: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_groups:
                insort(rooms, room)
            open_groups.setdefault(room, []).append((first, n))

    for size, left in kept:
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size
                n = -(-left // per)
                room, first = capacity, sequences
                sequences += n
            else:
                room = rooms[at]
                first, n = open_groups[room].pop()
                if not open_groups[room]:
                    del open_groups[room]
                    del rooms[at]
                per = room // size
            whole = min(n, left // per)
            if whole:
                place(size, whole, first, per, capacity - room)
                add(room - per * size, first, whole)
                left -= whole * per
            rest = min(per, left) if whole < n else 0
            if rest:
                place(size, 1, first + whole, rest, capacity - room)
                add(room - rest * size, first + whole, 1)
                left -= rest
            add(room, first + whole + bool(rest), n - whole - bool(rest))
    return slots


def _assign(slots: list[tuple[int, int, int, int, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(sorted(slots), np.int64).reshape(-1, 6)
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in released(batches):
            length, rank = (batch.column(c).to_numpy() for c in ("length", "__reel_rank"))
            slot = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1] if len(length) else table[:0]
            nth = rank - slot[:, 1]
            sequence = slot[:, 3] + nth // slot[:, 4]
            offset = slot[:, 5] + nth % slot[:, 4] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece.

    Each document's ids end with END_ID, so a null or empty text is one piece
    of length 1. Only documents over ``capacity`` are cut. Sequences have no
    gaps: offsets start at 0 and each piece follows the one before. Repeated
    rows and null doc_ids are packed like any other; other columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    # Ranks within a length: a length may hold a third of all pieces, so each is dealt to many parts.
    parts = max(64, shuffle_partitions(spark))
    part = F.pmod(F.xxhash64("doc_id", KEY, "piece", F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    dealt = token_pieces(docs, tokenizer_path, capacity).withColumn("__reel_part", part).checkpoint()
    counts = dealt.groupBy("length", "__reel_part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("length").orderBy("__reel_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__reel_before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = plan_sequences(histogram, capacity)
    within = F.row_number().over(Window.partitionBy("length", "__reel_part").orderBy("doc_id", KEY, "piece"))
    ranked = (dealt.withColumn("__reel_n", within).join(before, ["length", "__reel_part"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__reel_before") + F.col("__reel_n") - 1).alias("__reel_rank")))
    return ranked.mapInArrow(_assign(slots), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
                                             "sequence_id bigint, offset bigint")
