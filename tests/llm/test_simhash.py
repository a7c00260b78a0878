from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from reelspark.llm import simhash
from reelspark.llm.simhash import fingerprint, fingerprint_links, simhash_duplicates, thresholds


def _plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(prints):
    """Component (as the least index) of each fingerprint, by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "Zß", "\x1fc", "d\xa0e", "é", "x" * 40]), max_size=40), st.sampled_from([" ", "\t", "\r\n", " \x0b\x0c"]))
def test_fingerprint_by_definition(words, gap):
    assert fingerprint(gap.join(words).encode()) == _plain_print(gap.join(words))


def test_long_text_in_blocks():
    rnd = random.Random(3)
    text = " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 5) for _ in range(3 * simhash.BLOCK))
    assert fingerprint(text.encode()) == _plain_print(text)


def _near_prints(seed, n, base_bits):
    """Fingerprints about a few centres, with 1 to 5 bits changed, and bits that go together."""
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        c = rnd.choice(centres) if rnd.random() < 0.7 else rnd.getrandbits(64)
        for b in rnd.sample(range(base_bits), rnd.randint(0, 5)):
            c ^= 1 << b
        if rnd.random() < 0.3:
            c |= 0xFFFF
        out.add(c)
    return sorted(out)


@pytest.mark.parametrize(("parts", "limit", "base"), [(2, 64, 64), (3, 64, 64), (4, 64, 64), (4, 3, 64), (3, 0, 20), (4, 10**9, 20), (3, 20, 8)])
def test_links_equal_all_pairs(spark, monkeypatch, parts, limit, base):
    monkeypatch.setattr(simhash, "number_of_parts", lambda n: parts)
    prints = _near_prints(parts * 100 + base, 150, base)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    at = {p: i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for r in fingerprint_links(df, limit).collect():
        u, v = r.u % (1 << 64), r.v % (1 << 64)
        assert 0 < (u ^ v).bit_count() <= 2
        a, b = find(at[u]), find(at[v])
        parent[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(prints))] == _roots(prints)


def test_thresholds_are_the_cheapest():
    rng = np.random.default_rng(1)
    widths, n = [16, 16, 16, 16], 1000
    shares = rng.random((4, 3)) * 0.1
    counts = rng.integers(1, 400, (50, 4))
    cost = lambda row, k, t: 0 if t < 0 else [1, 17, 137][t] + counts[row, k] + n * shares[k, 1:t + 1].sum()
    options = [o for o in np.ndindex(4, 4, 4, 4) if sum(o) == 3]
    got = thresholds(counts, shares, n, widths)
    assert (got.sum(axis=1) == 2 - 4 + 1).all()
    for row in range(50):
        best = min(sum(cost(row, k, o[k] - 1) for k in range(4)) for o in options)
        assert sum(cost(row, k, got[row, k]) for k in range(4)) == pytest.approx(best)


def test_every_bit_is_in_one_part_beside_its_like(spark):
    rnd = random.Random(9)
    # bits 40 to 55 are all set or all clear, the others are independent
    prints = sorted({rnd.getrandbits(64) & ~(0xFFFF << 40) | rnd.choice([0, 0xFFFF << 40]) for _ in range(2000)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    together = simhash.bit_statistics(df)
    ones = np.array([[p >> b & 1 for b in range(64)] for p in prints])
    assert (together == ones.T @ ones).all()
    parts = simhash.grouped_bits(together, len(prints), 3)
    assert sorted(np.concatenate(parts).tolist()) == list(range(64)) and {len(p) for p in parts} == {21, 22}
    assert set(range(40, 56)) <= set(next(p for p in parts if 40 in p).tolist())


def _check(rows, got):
    prints = [_plain_print(t) for _, t in rows]
    distinct = sorted(set(prints))
    root = dict(zip(distinct, _roots(distinct), strict=True))
    least = {}
    for (d, _), p in zip(rows, prints, strict=True):
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    want = sorted(((d, f"{p:016x}", least.get(root[p])) for (d, _), p in zip(rows, prints, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want


def test_documents_against_all_pairs(spark, make_docs, sample_rows):
    rnd = random.Random(5)
    text = " ".join(f"w{rnd.randrange(500)}" for _ in range(900))
    near = []
    for i in range(40):
        words = text.split()
        words[rnd.randrange(900)] = f"new{i}"
        near.append((7000 + i, " ".join(words)))
    odd = [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "One"), (9004, "one"), (9005, "a b c"), (9005, "a b c"), (None, "a b c"),
           (None, "only here and without an id"), (9006, "x " * 50_000), (9006, text), (-4, text.upper())]
    rows = sample_rows + near + odd
    _check(rows, simhash_duplicates(make_docs(rows)).collect())
    _check(rows, simhash_duplicates(make_docs(rows), limit=2).collect())


def test_empty_and_single(spark, make_docs):
    assert simhash_duplicates(make_docs([])).collect() == []
    _check([(5, "a b")], simhash_duplicates(make_docs([(5, "a b")])).collect())
