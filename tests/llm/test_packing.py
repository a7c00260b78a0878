from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelspark.llm.packing import pack, plan_sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


def _ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def _check_layout(pieces, capacity):
    """pieces: (length, sequence, offset); every sequence gapless from 0 and within capacity."""
    by = defaultdict(list)
    for length, sequence, offset in pieces:
        by[sequence].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def _laid_out(sizes, capacity):
    slots = plan_sequences(Counter(sizes), capacity)
    pieces = [(size, first + r // per, offset + r % per * size) for size, lo, hi, first, per, offset in slots for r in range(hi - lo)]
    ranks = sorted((s[0], r) for s in slots for r in range(s[1], s[2]))
    assert ranks == sorted((s, r) for s, n in Counter(sizes).items() for r in range(n))
    return _check_layout(pieces, capacity)


def _optimum(sizes, capacity):
    """Fewest bins, by search over assignments with symmetry broken."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= sizes[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, [*rest, r - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_plan_is_near_the_optimum(sizes):
    assert _laid_out(sizes, 20) <= _optimum(sizes, 20) + 1


def test_dominance_fixes_exact_pairs():
    assert _laid_out([12, 8, 11, 9, 7, 7, 6], 20) == 3  # 12+8, 11+9, 7+7+6


def test_large_histogram():
    rnd = random.Random(1)
    sizes = [min(2048, int(rnd.lognormvariate(6, 1.2)) + 1) for _ in range(30000)]
    bins = _laid_out(sizes, 2048)
    assert bins <= -(-sum(sizes) // 2048) * 1.01 + 1


def test_pieces_and_places(make_docs, sample_rows):
    rows = sample_rows[:150] + [(9001, ""), (9002, None), (9003, "don't <|endoftext|> stop now ́e ÀÉ x1234"), (None, "hello"),
                                (9004, "same text"), (9004, "same text"), (9005, "word " * 9000)]
    got = pack(make_docs(rows), PATH, 2048).collect()
    assert _check_layout([(r.length, r.sequence_id, r.offset) for r in got], 2048) >= 1
    expected = Counter()
    for d, t in rows:
        ids = np.array(_ids(t), "<u4")
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s:s + 2048]
            expected[(d, p, s, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected


def test_empty_table(make_docs):
    assert pack(make_docs([]), PATH).count() == 0


def test_runs_that_a_running_hash_takes_for_one():
    """The Thue-Morse word and its complement agree under every polynomial hash modulo 2^64."""
    from tokenizers import Tokenizer

    from reelspark.llm import packing
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    tokenizer = Tokenizer.from_file(PATH)
    worker = packing._RunIds(PATH)
    for texts in ([word, other], [f"before {word}"], [f"{other} after", "plain words"], [word + " " + other, word], [other]):
        assert [x.tolist() for x in worker.ids(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
