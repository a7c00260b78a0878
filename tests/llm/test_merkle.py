from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from reelspark.llm import merkle
from reelspark.llm.merkle import fold, manifest, sweep_down, sweep_up, verified_manifest


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _tree(nodes):
    """Root and, per leaf, the list of (before, after), level by level."""
    at, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, p in enumerate(at):
            proofs[i].append((nodes[p - 1], "") if p % 2 else ("", nodes[p + 1] if p + 1 < len(nodes) else ""))
        at = [p // 2 for p in at]
        nodes = [_h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], proofs


def _plain(rows):
    """Rows of the manifest and of its check after tampering, from the definition."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r, _leaf(*r)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[lang] = _tree([leaf for _, leaf in by_lang[lang]])
    root, above = _tree([trees[lang][0] for lang in langs])
    out = []
    for lang, tail in zip(langs, above, strict=True):
        for (r, leaf), proof in zip(by_lang[lang], trees[lang][1], strict=True):
            given = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                given = _leaf(*r[:3], r[3] + 1, r[4])
            for before, after in proof + tail:
                given = _h(before, given, after)
            out.append((r[0], leaf, trees[lang][0], root, _h(*(x for s in proof + tail for x in s)), given, given == root))
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def _docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.selectExpr("*", "'x' AS leaf", "1 AS pos", "2 AS tree", "'y' AS digest", "3 AS part", "4 AS total", "5 AS at", "'z' AS steps", "'r' AS root")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 13])
@pytest.mark.parametrize("first", [0, 16])
def test_sweeps_of_one_block(n, first):
    leaves = [_h(str(i)) for i in range(n)]
    root, proofs = _tree(leaves)
    nodes = sweep_up(first, leaves, (n - 1).bit_length())
    assert list(nodes[-1].values()) == [root]
    assert sweep_down(nodes, (("t", ""),)) == {first + i: (*p, ("t", "")) for i, p in enumerate(proofs)}


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_by_definition(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rnd = random.Random(levels)
    sizes = {"en": 37, "de": 16, "fr": 1, None: 5, "": 2, "zh中": 9, "\U0001f600": 3, "￮": 2}
    rows, ids = [], list(range(1000))
    rnd.shuffle(ids)
    for lang, n in sizes.items():
        rows += [(ids.pop(), rnd.choice(["s", None, ""]), lang, rnd.choice([None, 0, -3, 12]), rnd.choice([None, "", "text é", "x" * 30])) for _ in range(n)]
    rows += [(None, "s", "en", 3, "abc"), (None, None, None, None, None), (rows[0][0], "again", "en", 1, "one id, two texts"), (2**62, "s", "en", 2**63 - 1, "y" * 300_000)]
    assert _got(verified_manifest(_docs(spark, rows))) == _plain(rows)


def test_repeated_rows(spark):
    rows = [(7, "s", "en", 2, "ab")] * 3 + [(8, "s", "en", 2, "ab"), (None, None, "en", None, None), (None, None, "en", None, None)]
    assert _got(verified_manifest(_docs(spark, rows))) == _plain(rows)


def test_small_tables(spark):
    for rows in ([(1, "s", "en", 2, "ab")], [(1, "s", None, 2, "ab"), (2, None, "en", 2, "ab")], [(3, "s", "en", 2, None), (2, "s", "en", 2, "")]):
        assert _got(verified_manifest(_docs(spark, rows))) == _plain(rows)
    empty = verified_manifest(_docs(spark, []))
    assert empty.collect() == [] and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_proofs_lead_to_the_root(spark, make_docs, sample_rows):
    got = manifest(make_docs(sample_rows), {"size": F.col("n_chars")})
    assert got.where(fold(F.col("leaf"), F.col("steps")) != F.col("root")).count() == 0
    assert got.agg(F.count("size"), F.countDistinct("position"), F.countDistinct("root")).first() == (len(sample_rows), len(sample_rows), 1)
