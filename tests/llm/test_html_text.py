from __future__ import annotations

import html
import re

import numpy as np

from reelspark.llm.html_text import RUN, extract_text, repeated_runs

SCHEMA = "page_id bigint, url string, html string, texts string, host string"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "t", "h") for r in rows], SCHEMA)


def test_driver_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in extract_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        text = " ".join(html.unescape(re.sub(r"</?(?:b)>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))).split())
        assert got[r.page_id].text == text and got[r.page_id].n_chars == len(text)


def test_furniture_and_markup(spark):
    page = ("<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav>Menu</nav><div class='cookie-notice'>Accept</div>"
            "<main><article class='post'><header><h1>Head &amp; tail</h1><p>By X</p></header><p>One<b>two</b>&nbsp;three<br>four<p class=ad>Buy<p>five"
            "<form><p>Mail?</p></form><script>var a='<p>no</p>';</script><aside>Side</aside><ul><li>six<li>seven</ul><!-- gone -->"
            "<div id='comments'><p>First!</p></div></article></main><footer>Foot</footer></body></html>")
    cases = {1: (page, "Head & tail Onetwo three four five six seven"), 2: (None, ""), 3: ("", ""), 4: ("<script>x", ""),
             5: ("plain &lt;text&gt;", "plain <text>"), 6: ("<p>a < b and c > d</p>", "a < b and c > d"), 7: ("<article></article>", ""),
             8: ("<article><p>" + "long " * 50000 + "</p></article>", ("long " * 50000).strip()),
             10: ("<article><p title='a hidden role=\"menu\" gem' data-id=ad>Kept</p><ol class=commentlist><li>no</ol></article>", "Kept"),
             9: ("<div class=\"content-with-sidebar\"><article><p>In</p></article></div>", "In")}
    got = {r.page_id: r for r in extract_text(_pages(spark, [(i, f"http://h{i}.example/x", h) for i, (h, _) in cases.items()])).collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, (_, t) in cases.items()}
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_repeated_runs_of_a_host_go_when_nothing_marks_the_article(spark):
    shared = "welcome to the site of all sites read our other pages too"
    rows = [(i, "http://h.example/%d" % i, f"<div>{shared}</div><div>{' '.join(f'n{i}x{j}' for j in range(20))}</div>") for i in range(12)]
    rows += [(50, None, f"<div>{shared}</div>"), (51, "http://H.example/0", rows[0][2]), (51, "http://H.example/0", rows[0][2])]
    got = {r.page_id: r.text for r in extract_text(_pages(spark, rows)).collect()}
    assert got[3] == " ".join(f"n3x{j}" for j in range(20))
    assert got[50] == shared and got[51] == got[0] != ""


def test_marked_pages_lose_repeated_runs_and_keep_main_beside_articles(spark):
    share = "did you like this story then tell all of your friends about it"
    own = lambda i: " ".join(f"n{i}x{j}" for j in range(20))
    rows = [(i, f"http://a.example/{i}", f"<article><p>{own(i)}</p><p>{share}</p></article>") for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", f"<article><p>{own(i)}</p>" + (f"<p>{share}</p>" if i < 3 else "") + "</article>") for i in range(12)]
    rows += [(200, "http://c.example/", f"<main><p>{own(200)}</p><article>card one</article></main><article>card two</article><p>loose</p>")]
    got = {r.page_id: r.text for r in extract_text(_pages(spark, rows)).collect()}
    assert all(got[i] == own(i) for i in range(12))
    assert got[100] == f"{own(0)} {share}"  # a quotation on a few pages stays
    assert got[200] == f"{own(200)} card one card two"


def test_suffix_ranks_equal_brute_force():
    rnd = np.random.default_rng(6)
    for _ in range(20):
        streams = [rnd.integers(0, 3, rnd.integers(0, 40)) for _ in range(5)]
        content = [0, 1, 2, 3, 3]
        got = repeated_runs(streams, content)
        for s, cover in zip(streams, got, strict=True):
            want = np.zeros(len(s), bool)
            for a in range(len(s) - RUN + 1):
                run = s[a:a + RUN].tolist()
                on = {c for t, c in zip(streams, content, strict=True) if any(t[b:b + RUN].tolist() == run for b in range(len(t) - RUN + 1))}
                if len(on) >= 3:
                    want[a:a + RUN] = True
            assert (want == cover).all()


def test_empty_table(spark):
    assert extract_text(_pages(spark, []).limit(0)).count() == 0


def test_near_copies_keep_their_text(spark):
    """Articles that differ in a word or two are not each other's furniture, marked or not."""
    words = " ".join(f"w{j}" for j in range(200))
    other = lambda i: " ".join(f"o{i}x{j}" for j in range(200))
    rows = [(i, f"http://a.example/{i}", f"<article><p>{words} last{i}</p></article>") for i in range(6)]
    rows += [(10 + i, f"http://a.example/o{i}", f"<article><p>{other(i)}</p></article>") for i in range(6)]
    rows += [(20 + i, f"http://b.example/{i}", f"<div>{words} last{i}</div>") for i in range(3)]
    rows += [(30 + i, f"http://b.example/o{i}", f"<div>{other(i)}</div>") for i in range(3)]
    got = {r.page_id: r.text for r in extract_text(_pages(spark, rows)).collect()}
    assert all(got[i] == got[20 + i % 3].replace(f"last{i % 3}", f"last{i}") == f"{words} last{i}" for i in range(6))
    assert all(got[10 + i] == other(i) for i in range(6))


def test_parts_do_not_depend_on_the_layout(spark, monkeypatch):
    """The same pages from 2 and from 5 files, in one part and in several."""
    from reelspark.llm import html_text
    notice = "this section has moved to another place on our new site"
    rows = [(i, f"http://a.example/{i}", f"<div>{notice}</div><div>{' '.join(f'n{i}x{j}' for j in range(30))}</div>") for i in range(60)]
    monkeypatch.setattr(html_text, "PART_CHARS", 4000)
    texts = [sorted(tuple(r) for r in extract_text(_pages(spark, rows).repartition(n)).collect()) for n in (2, 5)]
    monkeypatch.setattr(html_text, "PART_CHARS", 4_000_000)
    assert texts[0] == texts[1] == sorted(tuple(r) for r in extract_text(_pages(spark, rows)).collect())
    assert all(notice not in r[2] for r in texts[0])


def test_runs_near_the_threshold_are_counted_over_the_whole_host(spark, monkeypatch):
    """Notices on 19 to 22 of 100 pages, marked and not, with copies: many parts give the texts of one part and of the rule."""
    from reelspark.llm import html_text
    notice = {k: " ".join(f"k{k}w{j}" for j in range(9)) for k in (17, 19, 20, 21, 22, 39, 40, 41)}
    rows, streams = [], []
    for i in range(100):
        text = [" ".join(f"n{i}x{j}" for j in range(40)), *(t for k, t in notice.items() if (i * 37 + k) % 100 < k)]
        streams.append(" ".join(text).split())
        body = "".join(f"<div>{t}</div>" for t in text)
        rows += [(i, f"http://a.example/{i}", body), (100 + i, f"http://b.example/{i}", f"<article>{body}</article>")]
        rows += [(1000 + 10 * i + c, f"http://a.example/{i}/{c}", body) for c in range(i % 4)]
    number = {w: i for i, w in enumerate(sorted({w for s in streams for w in s}))}
    ids = [np.array([number[w] for w in s]) for s in streams]
    want = {}
    for times, first in ((1, 0), (html_text.MARKED, 100)):
        for i, gone in enumerate(repeated_runs(ids, list(range(100)), times)):
            want[first + i] = " ".join(w for w, g in zip(streams[i], gone, strict=True) if not g)
    for i in range(100):
        want |= {1000 + 10 * i + c: want[i] for c in range(i % 4)}
    for chars in (2000, 10_000, 4_000_000):
        monkeypatch.setattr(html_text, "PART_CHARS", chars)
        assert {r.page_id: r.text for r in extract_text(_pages(spark, rows).repartition(3)).collect()} == want
