"""The fusion of evidence against the formulas written out row by row."""

from __future__ import annotations

import math
import random

import pytest

from reelspark.llm import lang_id
from reelspark.llm.lang_id import fuse, identify, keep_identified

LANGS = ["de", "en", "fr"]


def _softmax(xs):
    top = max(xs)
    e = [math.exp(x - top) for x in xs]
    return [x / sum(e) for x in e]


def _plain(rows):
    """rows: (id, n, ll, declared, address, host) -> id -> (lang, p, text_lang, accepted)."""
    size = range(len(rows[0][2]))
    post = [_softmax([x / lang_id.TEMPER for x in r[2]]) if r[1] else [0.0] * len(size) for r in rows]
    total = [sum(p[i] for p in post) for i in size]
    base = [(t + 1) / (sum(total) + len(size)) for t in total]

    def sums(col, value, but=None):
        if value is None:
            return [0.0] * len(size)
        found = [sum(p[i] for r, p in zip(rows, post, strict=True) if r[col] == value and r[1]) for i in size]
        return [max(0.0, f - p) for f, p in zip(found, but, strict=True)] if but else found

    def value_given(col, value):
        if value is None or not any(r[col] == value and r[1] for r in rows):
            return [0.0] * len(size)
        return [math.log((s + b) / (t + 1)) for s, b, t in zip(sums(col, value), base, total, strict=True)]

    out = {}
    for r, p in zip(rows, post, strict=True):
        a, h = sums(4, r[4], p), sums(5, r[5], p)
        near = [(x + lang_id.ADDRESS_PRIOR * b) / (sum(a) + lang_id.ADDRESS_PRIOR) for x, b in zip(a, base, strict=True)]
        prior = [(x + lang_id.HOST_PRIOR * m) / (sum(h) + lang_id.HOST_PRIOR) for x, m in zip(h, near, strict=True)]
        logs = [math.log(pr) + (x / lang_id.TEMPER if r[1] else 0) + d + s
                for pr, x, d, s in zip(prior, r[2], value_given(3, r[3]), value_given(4, r[4]), strict=True)]
        q = _softmax(logs)
        ok = r[1] > 0 and max(r[2]) >= -math.log(lang_id.BUCKETS) * r[1] - lang_id.DOUBT
        best = max(size, key=lambda i: (q[i], -i))
        text = max(size, key=lambda i: (r[2][i], -i))
        out[r[0]] = (best if ok else None, q[best] if ok else 0.0, text if r[1] else None, ok)
    return out


def test_fusion_row_by_row(spark):
    """Weak texts, so that the declared language, the address and the host decide; the true language is none of the inputs."""
    rnd = random.Random(4)
    rows = []
    for i in range(300):
        true = rnd.randrange(3)
        n = rnd.choice([0, 1, 2, 5, 40])
        ll = [-8.0 * n - rnd.random() * 3 - (0 if j == true else rnd.random() * 4) for j in range(3)] if n else [0.0] * 3
        if rnd.random() < 0.1 and n:
            ll = [x - 4.0 * n - 8 for x in ll]  # fits no language, or hardly
        declared = rnd.choice([None, LANGS[true], LANGS[true], rnd.choice(LANGS), "xx"])
        address = rnd.choice([None, ["de", "com/en", "fr"][true], "com"])
        host = rnd.choice([None, f"h{true}", f"h{true}", "big"])
        rows.append((i, n, ll, declared, address, host))
    rows += [(900, 0, [0.0] * 3, None, None, "nowhere"), (901, 0, [0.0] * 3, "only", "here", "alone"), (902, 3, [-20.0] * 3, None, None, None)]
    df = spark.createDataFrame(rows, "id int, n bigint, ll array<double>, declared string, address string, host string").repartition(5)
    got = {r.id: r for r in fuse(df, LANGS).collect()}
    want = _plain(rows)
    assert len(got) == len(rows)
    moved = 0
    for i, (lang, p, text, ok) in want.items():
        r = got[i]
        assert r.accepted == ok and r.p == pytest.approx(p, abs=1e-9)
        assert r.lang == (LANGS[lang] if lang is not None else "und") and r.text_lang == (LANGS[text] if text is not None else "und")
        moved += ok and lang != text
    assert moved > 20  # the other evidence overrules the text often enough to matter


def test_a_hundred_languages(spark):
    """Each label has words of its own; what is declared in the test rows is noise."""
    rnd = random.Random(6)
    words = [["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for _ in range(100)]
    text = lambda k: " ".join(rnd.choice(words[k]) for _ in range(15))
    rows = [(100 * k + j, text(k), f"l{k:02d}", f"src{k}", 1) for k in range(100) for j in range(6)]
    noise = [(50_000 + k, text(k), f"l{rnd.randrange(100):02d}", f"src{k}", 1) for k in range(100)]
    docs = spark.createDataFrame(rows + noise, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in identify(docs).collect()}
    assert sum(got[50_000 + k].lang == f"l{k:02d}" for k in range(100)) >= 97
    assert all(got[100 * k + j].lang == f"l{k:02d}" for k in range(100) for j in range(6))


def test_rare_labels_stay_evidence(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the house and the river", "en", "s", 1) for i in range(9)] + [(20 + i, "das haus und der fluss", "de", "s", 1) for i in range(8)]
                                 + [(40, "la maison et la riviere", "fr", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    languages, model = lang_id.fit_text_model(docs.selectExpr("text", "lang AS label"), languages=2)
    assert languages == ["de", "en"] and model.shape == (lang_id.BUCKETS, 2)


def test_pages_with_odd_rows(spark):
    docs = spark.createDataFrame([(i, "the house and the river under the hill", "en", "s", 1) for i in range(5)]
                                 + [(10 + i, "das haus und der fluss unter dem berg", "de", "s", 1) for i in range(5)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    html = "<html lang='de'><p>das haus und der fluss</p></html>"
    rows = [(1, "https://a.de/x", html), (1, "https://a.de/x", html), (2, None, html), (3, "https://a.de/x", None), (4, "", ""), (None, "https://b.com/en/", "<p>the river</p>"),
            (5, "no url", "<html lang=en><b>the house</b>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS host", "'y' AS kind", "'z' AS lang", "1 AS n", "2 AS ll")
    got = [r for r in identify(docs, pages).collect() if r.kind == "pages"]
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].lang == "de" and by[2].lang == "de" and by[2].host is None and by[5].lang == "en" and by[None].lang == "en"
    assert (by[3].lang, by[3].p, by[3].accepted) == ("und", 0.0, False) == (by[4].lang, by[4].p, by[4].accepted)
    assert identify(docs.limit(0), pages.limit(0)).count() == 0
    assert {r.lang for r in identify(docs.limit(0), pages).collect()} == {"und"}
    assert keep_identified(docs.limit(0)).count() == 0
