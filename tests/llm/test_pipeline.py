from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
from corpus_pipeline import STAGES
from reelspark.sources.driver_tables import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _stage(name):
    return dict(STAGES)[name]


def _near_groups(rows, percent=80):
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").encode().lower().split()) else None for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for o, n in Counter(o for x in s or () for o in where[x]).items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                parent[find(i)] = find(o)
        for x in s or ():
            where[x].append(i)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    return groups


def test_stages_on_their_own_input(spark, sf_dir, tmp_path):
    """Each stage against a plain version of it, on what the one before kept."""
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    inputs = {}
    for k, (name, stage) in enumerate(STAGES):
        inputs[name] = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, sf_dir)
        assert name == "packing" or out.columns == columns
        out.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
    last = docs.collect()

    has_letters = [d for d, t in inputs["language"] if any(c.isalpha() for c in t or "")]
    assert sorted(d for d, _ in inputs["lines"]) == sorted(has_letters)

    before = {d: t for d, t in inputs["lines"]}
    for d, t in inputs["near_duplicates"]:
        lines = iter(before[d].split("\n"))
        assert all(any(x == y for y in lines) for x in t.split("\n"))  # nothing but whole lines went

    kept = {d for d, _ in inputs["benchmark"]}
    groups = _near_groups(inputs["near_duplicates"])
    assert kept == {min(g) for g in groups.values()}

    words = lambda t: WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {tuple(w[i:i + 10]) for r in table(spark, sf_dir, "benchmark").collect() for w in [words(r.text)] for i in range(len(w) - 9)}
    hit = {d for d, t in inputs["benchmark"] for w in [words(t)] if any(tuple(w[i:i + 10]) in windows for i in range(len(w) - 9))}
    assert hit and {d for d, _ in inputs["packing"]} == kept - hit

    assert {r.doc_id for r in last} == kept - hit
    room = Counter()
    for r in last:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 2048 and len(room) <= 1.02 * sum(room.values()) / 2048 + 1


def test_run_and_odd_documents(spark, make_docs, sf_dir, tmp_path):
    long_line = " ".join(f"l{j}" for j in range(60))
    docs = make_docs([(1, None), (2, ""), (3, "the river house " * 30), (3, "the river house " * 30), (4, long_line), (5, long_line + "\nand more"),
                      (None, "a house by the river"), (6, "123 !!!")])
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["3", "4", "5", "None"]
    empty = make_docs([])
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, empty, sf_dir).write.parquet(str(tmp_path / f"e{k}"))
        empty = spark.read.parquet(str(tmp_path / f"e{k}"))
        assert empty.count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
