from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from reelspark.llm import oracles
from reelspark.llm.license_scan import scan_licences
from reelspark.llm.secret_scan import RULES, Rule, findings, unseen, update_ledger

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")

ODD = [(9001, None), (9002, ""), (9003, "Password: abc"), (9004, "token=secret:abcdefghij"), (9005, "token=password=abcdefgh"),
       (9006, "é😀 api_key = 'ABCDEFGH12' AKIAABCDEFGHIJKL0 " + "0123456789abcdef" * 3 + "g"), (9007, "f" * 31 + " " + "f" * 32),
       (9008, "AKIA AKIAAAAAAAAAAAAAA"), (9009, "API-KEY=xxxxxxxxxx apikey:yyyyyyyy"), (9010, "secret='12345678' " * 50),
       (9011, "-----BEGIN RSA PRIVATE KEY-----\nxx"), (None, "passwd=12345678"), (9012, "passwd=12345678"), (9012, "passwd=12345678"),
       (9013, "x" * 200000 + " token: abcdefgh")]


def _base(text):
    spans = []
    for k, (kind, pattern) in enumerate((("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))):
        for m in pattern.finditer(text or ""):
            n = len(m.group(2)) if kind == "assign" else m.end() - m.start()
            if n >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                spans.append((m.start(), k, kind, m.end()))
    return sorted(spans)


def test_secrets_equal_brute_force(spark, make_docs, sample_rows, tmp_path):
    rows = sample_rows + ODD
    docs = make_docs(rows)
    got = findings(docs, update_ledger(docs, str(tmp_path / "ledger"))).collect()
    want = Counter()
    for d, t in rows:
        spans = _base(t)
        kinds = Counter(s[2] for s in spans)
        joined = ",".join(f"{k}:{a}:{e}" for a, _, k, e in spans)
        want[(d, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert {r.spans for r in got if r.doc_id == 9011} == {"pem:0:31"}


def test_ledger_scans_only_what_is_new(spark, make_docs, tmp_path):
    path = str(tmp_path / "ledger")
    one = make_docs([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "clean")])
    assert update_ledger(one, path).count() == 2  # one row per distinct text
    two = make_docs([(1, "token=abcdefgh"), (1, "token=ijklmnop"), (4, "clean")])
    ledger = update_ledger(two, path)
    assert ledger.count() == 3
    assert Counter((r.doc_id, r.spans) for r in findings(two, ledger).collect()) == Counter(
        [(1, "assign:0:14"), (1, "assign:0:14"), (4, "")])
    newer = (*RULES, Rule("word", 1, r"clean", hints=("clean",)))
    ledger = update_ledger(two, path, newer)
    assert sorted(x for r in ledger.collect() for x in r.rules).count("word@1") == 3
    assert {r.spans for r in findings(two, ledger, newer).collect()} == {"assign:0:14", "word:0:5"}


def test_findings_of_an_older_rule_version_go(spark, make_docs, tmp_path):
    path = str(tmp_path / "ledger")
    docs = make_docs([(1, "token=abcdefgh and more"), (None, "key: 0000"), (None, "key: 0000"), (2, None)])
    first = (*RULES, Rule("key", 1, r"key: [0-9]+", hints=("key: ",)))
    assert {r.spans for r in findings(docs, update_ledger(docs, path, first), first).collect()} == {"assign:0:14", "key:0:9", ""}
    second = (*RULES, Rule("key", 2, r"key: 00", hints=("key: ",)))
    ledger = update_ledger(docs, path, second)
    assert {r.spans for r in findings(docs, ledger, second).collect()} == {"assign:0:14", "key:0:7", ""}
    assert {r.spans for r in findings(docs, ledger).collect()} == {"assign:0:14", ""}
    assert unseen(docs, ledger, second).count() == 0
    assert {(r.text, tuple(r.todo)) for r in unseen(make_docs([(5, "new"), (6, "new"), (1, "token=abcdefgh and more")]), ledger).collect()} == {
        ("new", tuple(r.id for r in RULES))}


def test_licences(make_docs):
    rows = [(1, "Text here.\nLicensed under the Apache License, Version 2.0."), (2, "All rights reserved."), (3, None), (4, ""),
            (5, "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License."),
            (6, "Permission is hereby granted, free of charge, to any person obtaining a copy of this. The above copyright notice and this "
                "permission notice shall be included in all copies. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY of any kind."),
            (7, "Licensed under CC BY-NC 4.0."), (8, "A license of some kind."), (None, "All rights reserved"), (9, "no topic here. " * 5000),
            (2, "All rights reserved.")]
    got = Counter((r.doc_id, r.n_sentences, r.sentences, r.licenses) for r in scan_licences(make_docs(rows)).collect())
    assert got == Counter([
        (1, 1, "Apache2", "Apache-2.0"), (2, 1, "AllRights", "all-rights-reserved"), (3, 0, "", ""), (4, 0, "", ""),
        (5, 2, "Gpl3,MitName", "MIT,GPL-3.0"), (6, 3, "MitGrant,MitNotice,AsIs", "MIT"), (7, 1, "CcByNc", "CC-BY-NC"), (8, 1, "UNKNOWN", ""),
        (None, 1, "AllRights", "all-rights-reserved"), (9, 0, "", ""), (2, 1, "AllRights", "all-rights-reserved")])
    assert scan_licences(make_docs([])).count() == 0


@pytest.mark.parametrize("key", ["op1_licences", "op5_secrets", "op7_decontaminate"])
def test_queries_equal_duckdb(spark, sf_dir, duck, key):
    from reelspark.llm.catalog import ORACLES, QUERIES
    df = QUERIES[key](spark, sf_dir)
    sql = duck.execute(ORACLES[key])
    names = [c[0] for c in sql.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(dict(zip(names, r, strict=True))[c] for c in df.columns) for r in sql.fetchall())
    assert Counter(tuple(r) for r in df.collect()) == want


def test_no_python_on_the_native_path(spark, sf_dir):
    from reelspark.llm.catalog import QUERIES
    plan = QUERIES["op1_licences"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan


def test_oracle_text():
    assert "c0" in oracles.licences()
