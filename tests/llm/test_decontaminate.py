from __future__ import annotations

import hashlib
import re
from collections import Counter

from reelspark.llm.decontaminate import contamination_report, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def _brute(rows, items):
    windows = [(i, tuple(w[s:s + n])) for i, t in items for w in [_words(t)] if w
               for n in [min(10, len(w))] for s in range(len(w) - n + 1)]
    out = Counter()
    for d, t in rows:
        w = _words(t)
        hit, found = set(), set()
        grams = {}
        for n in {len(x) for _, x in windows}:
            for s in range(len(w) - n + 1):
                grams.setdefault(tuple(w[s:s + n]), []).append(s)
        for i, x in windows:
            for s in grams.get(x, ()):
                hit |= set(range(s, s + len(x)))
                found.add(str(i))
        ids = ",".join(sorted(found))
        out[(d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))] += 1
    return out


def test_report_equals_brute_force(spark, make_docs, sample_rows, duck):
    items = duck.execute("select item_id, text from benchmark").fetchall()
    items += [(901, "alpha beta"), (902, "Solo"), (903, ""), (904, None), (905, "x x x x x x x x x x x x"), (906, items[0][1]),
              (907, "one two three four five six seven eight nine ten")]
    long_item = items[1][1]
    rows = sample_rows + [(7001, f"start {long_item} end"), (7002, "ALPHA, beta! alpha beta"), (7003, None), (7004, ""), (None, "solo"),
                          (7005, "x " * 50), (7006, "one two three four five six seven eight nine"), (7007, "zero one two three four five six seven eight nine ten"),
                          (7008, "dup solo"), (7008, "dup solo"), (7009, "word " * 5000 + long_item)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = contamination_report(make_docs(rows), bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == _brute(rows, items)


def test_stage_and_empty_tables(spark, make_docs):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id bigint, text string")
    docs = make_docs([(1, "x a b c d e f g h i j y"), (2, "a b c d e f g h i"), (3, None), (4, ""), (None, "q a b c d e f g h i j")])
    assert sorted(str(r.doc_id) for r in drop_contaminated(docs, bench).collect()) == ["2", "3", "4"]
    assert drop_contaminated(docs, bench.limit(0)).count() == 5
    assert contamination_report(docs.limit(0), bench).count() == 0
