"""Main text of web pages: structure first, host suffix array for the rest.

A page is cut into blocks at block-level tags. Blocks inside elements that are
page furniture by tag, role or class (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) go. If the page
marks its text (``article`` or ``main``), only the marked blocks take part.
Then the pages of the same host decide: their token streams, all blocks end to
end, are sorted as suffixes to a depth of ``RUN`` tokens, so that equal runs lie
side by side; runs found on enough distinct pages of the host are boilerplate
and go, unique runs stay. In marked blocks a run must be on ``MARKED`` times as
many pages. Pages of equal content count as one (the one whose blocks hash
smallest), so that a copied article is not taken for furniture.

A host's contents are dealt by their hash into parts of about ``PART_CHARS``
characters, each a bounded task with a suffix array of its own. A part sends the
runs on ``SENT`` of its contents or more, and how many pages it may have left
unsaid of any other run; summed over the host, this settles a run that is
clearly over or under the host's threshold. The few between (most often none)
are counted once more in all parts. So the parts only share the work: how many
there are does not show in the texts. Runs are named by 64-bit hashes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import CACHE_ENTRIES, broadcast_if, hash_words, ngram_hashes, prepare, released
from reelspark.session import shuffle_files_removed

#: Tokens a repeated run has at least (a power of two).
RUN = 8
#: Distinct pages a run must be on, and their share of the host's pages.
MIN_PAGES, MIN_SHARE = 3, 0.2
#: Share of a part's pages a run must be on to be sent; under MIN_SHARE, results do not depend on it.
SENT = MIN_SHARE / 2
#: How many times as many pages a run inside article or main must be on.
MARKED = 2
#: Share of a page's tokens that must be left, else the page keeps them all.
LEFT = 0.1
PART_CHARS = 4_000_000

#: Element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noframes".split())
_DROP = frozenset("head script style noscript template svg math iframe object canvas audio video nav aside footer form button select "
                  "textarea menu dialog datalist".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
                    "sub sup time tt u var wbr".split())
#: What an opening tag closes if it is open: tag -> (closed, scope it does not leave).
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
           "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_CLASSES = frozenset("ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
                     "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup "
                     "promo promotion related respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split())
_CONTENT = frozenset("article body container content entry has main no page post story text title with without wrap wrapper".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
#: Beginnings of class names written as one word.
_STEMS = ("advert", "breadcrumb", "commentbox", "commentform", "commentlist", "commentthread", "cookie", "newsletter", "sidebar", "sponsor")

FURNITURE, OPEN, MAIN, ARTICLE = 0, 1, 2, 3


def _furniture(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is page furniture by its tag, role or class."""
    if tag in _DROP or tag == "header" and not inside:
        return True
    if tag in ("html", "body") or not attributes.strip():
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES:
            return True
        if name in ("class", "id"):
            for word in value.split():
                parts = set(re.split(r"[^a-z]+", re.sub(r"\d+", "", word)))
                hit = {x for x in parts if x in _CLASSES or x.startswith(_STEMS)}
                if hit and not parts & _CONTENT and not (inside and hit <= {"header", "banner"}):
                    return True
    return False


def page_blocks(page: str) -> list[tuple[str, int]]:
    """(text, zone) of each block of a page, in order, white space collapsed."""
    blocks: list[tuple[str, int]] = []
    words: list[str] = []
    # open elements: tag, zone of their text, furniture by class only (an article inside is none)
    stack: list[tuple[str, int, bool]] = [("", OPEN, False)]

    def flush() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            blocks.append((text, stack[-1][1]))

    def close(names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in scope:
                return

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            break
        if m.start() > at:
            piece = page[at:m.start()]
            words.append(html.unescape(piece) if "&" in piece else piece)
        at = m.end()
        ending, tag, attributes = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            if tag not in _INLINE or stack[-1][0] != tag:
                flush() if tag not in _INLINE else None
            if any(x[0] == tag for x in stack):
                if stack[-1][1] != next(stack[i - 1][1] for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag):
                    flush()
                close((tag,), ())
            continue
        if tag not in _INLINE:
            flush()
            if tag in _CLOSES:
                close(*_CLOSES[tag])
            elif tag not in _VOID:
                close(("p",), ("article", "main", "section", "div", "td", "th", "li", "blockquote", "body", "button", "object", "nav", "aside", "footer", "form"))
        if tag in _VOID:
            continue
        zone, by_class = stack[-1][1], stack[-1][2]
        inside = zone >= MAIN
        bad = _furniture(tag, attributes, inside)
        if zone == FURNITURE and not by_class:
            now = (tag, FURNITURE, False)
        elif bad:
            now = (tag, FURNITURE, tag not in _DROP and tag != "header")
        elif tag == "article":
            now = (tag, ARTICLE, False)
        elif tag == "main":
            now = (tag, max(zone, MAIN), False)
        elif tag == "header" and inside:
            now = (tag, FURNITURE, False)
        else:
            now = (tag, zone, by_class)
        if tag in _HEADINGS and not bad and any(x[0] == "header" for x in stack) and any(x[1] >= MAIN for x in stack):
            now = (tag, max(x[1] for x in stack), False)
        if now[1] != zone:
            flush()
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        stack.append(now)
    if at < size:
        piece = page[at:]
        words.append(html.unescape(piece) if "&" in piece else piece)
    flush()
    return blocks


_CONTENTS = "host string, __reel_part int, __reel_n int, content binary, variant binary, stream string"


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page's words with the hashes of its content and of all its blocks, dealt
    by content. Of pages of equal content a task sends a later one only if its
    blocks hash smaller (or the earlier are forgotten), so copies stay few."""
    sent: dict[tuple, bytes] = {}
    for batch in released(batches):
        rows = []
        for host, n, page in zip(*(batch.column(c).to_pylist() for c in ("host", "__reel_n", "html")), strict=True):
            blocks = page_blocks(page or "")
            content = xxhash.xxh3_128_digest("\n".join(t for t, z in blocks if z != FURNITURE).encode())
            variant = xxhash.xxh3_128_digest("\n".join(f"{z} {t}" for t, z in blocks).encode())
            if variant < sent.get((host, content), b"\xff" * 17):
                if len(sent) >= CACHE_ENTRIES:
                    sent.clear()
                sent[host, content] = variant
                rows.append((host, int.from_bytes(content[:8]) % n, n, content, variant, " ".join(t for t, _ in blocks)))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                         names=["host", "__reel_part", "__reel_n", "content", "variant", "stream"])


def _streams(table: pa.Table) -> list[list[str]]:
    """The words of each content of a part, those of its page whose blocks hash smallest."""
    best: dict[bytes, tuple] = {}
    for content, variant, stream in zip(*(table.column(c).to_pylist() for c in ("content", "variant", "stream")), strict=True):
        if content not in best or variant < best[content][0]:
            best[content] = (variant, stream)
    return [best[c][1].split() for c in sorted(best)]


def least_pages(n: int) -> int:
    """On how many of ``n`` distinct pages a run must be."""
    return max(MIN_PAGES, int(np.ceil(MIN_SHARE * n)))


def run_pages(streams: list[np.ndarray], content: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each token of the streams, end to end with a separator after each:
    the rank of the run of RUN tokens that starts there among all runs, and on
    how many pages of distinct content that run is."""
    # A separator of its own after every page keeps runs within a page.
    text = np.concatenate([np.append(s, -1 - i) for i, s in enumerate(streams)])
    page = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < RUN:  # suffixes sorted to twice the depth, by the ranks of their halves
        second = np.zeros_like(rank)
        second[:-depth] = rank[depth:] + 1
        rank = np.unique(rank * (len(rank) + 1) + second, return_inverse=True)[1]
        depth *= 2
    who = np.asarray(content, np.int64)[page]
    order = np.lexsort((who, rank))
    new_run = np.append(True, rank[order][1:] != rank[order][:-1])
    new_page = new_run | np.append(True, who[order][1:] != who[order][:-1])
    return rank, np.bincount(rank[order], weights=new_page)[rank]


def cover(starts: np.ndarray) -> np.ndarray:
    """Which tokens lie in a run, given where runs of RUN tokens start."""
    covered = np.zeros(len(starts) + RUN, np.int64)
    at = np.flatnonzero(starts)
    covered[at] += 1
    covered[at + RUN] -= 1
    return np.cumsum(covered)[:len(starts)] > 0


def repeated_runs(streams: list[np.ndarray], content: list[int], times: int = 1) -> list[np.ndarray]:
    """Which tokens of each stream lie in a run of RUN tokens or more that enough
    pages (``times`` as many) of distinct content share: the rule, for pages in
    one place."""
    sizes = [len(s) for s in streams]
    if not sum(sizes):
        return [np.zeros(n, bool) for n in sizes]
    inside = cover(run_pages(streams, content)[1] >= times * least_pages(len(set(content))))
    ends = np.cumsum([n + 1 for n in sizes])
    return [inside[e - n - 1:e - 1] for n, e in zip(sizes, ends, strict=True)]


_SENT = "host string, run bigint, pages bigint, below bigint"


def _sent_runs(table: pa.Table) -> pa.Table:
    """The runs of a part that are on enough of its contents, and on how many.
    ``below`` is how many the others are on at most; the row without a run has
    the number of contents."""
    streams = _streams(table)
    host, n = table.column("host")[0].as_py(), len(streams)
    # A host in one part needs no more than its own threshold.
    least = least_pages(n) if table.column("__reel_n")[0].as_py() == 1 else max(1, int(np.ceil(SENT * n)))
    number: dict[str, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in s], np.int64) for s in streams]
    runs, pages = np.empty(0, np.uint64), np.empty(0, np.int64)
    if any(len(s) >= RUN for s in ids):
        rank, on = run_pages(ids, list(range(n)))
        size = np.array([len(s) for s in ids])
        begin = np.cumsum(size + 1) - size - 1
        left = np.repeat(begin + size, size + 1) - np.arange(len(rank))  # tokens to the page's end
        at = np.flatnonzero((left >= RUN) & (on >= least))
        at = at[np.unique(rank[at], return_index=True)[1]]
        words = hash_words([w.encode() for w in number])
        text = np.concatenate([np.append(s, 0) for s in ids])
        runs = ngram_hashes(words[text], RUN)[at]
        pages = on[at].astype(np.int64)
    return pa.table({"host": pa.array([host] * (len(runs) + 1), pa.string()),
                     "run": pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(runs.view(np.int64))]),
                     "pages": pa.array(np.append(n, pages), pa.int64()), "below": pa.array(np.full(len(runs) + 1, least - 1), pa.int64())})


def _run_hashes(words: list[str]) -> np.ndarray:
    return ngram_hashes(hash_words([w.encode() for w in words]), RUN)


def _asked_runs(table: pa.Table, asked: pa.Table) -> pa.Table:
    """On how many contents of a part each run asked for is."""
    wanted = np.sort(asked.column("run").to_numpy().view(np.uint64))
    pages = np.zeros(len(wanted), np.int64)
    for words in _streams(table) if len(wanted) else ():
        found = np.unique(_run_hashes(words))
        pages[np.isin(wanted, found, assume_unique=True)] += 1
    at = np.flatnonzero(pages)
    host = asked.column("host")[0].as_py() if len(wanted) else ""
    return pa.table({"host": pa.array([host] * len(at), pa.string()), "run": pa.array(wanted[at].view(np.int64)), "pages": pa.array(pages[at])})


_BLOCKS = "page_id bigint, url string, host string, __reel_part int, texts array<string>, zones array<int>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        found = [page_blocks(h or "") for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("page_id", "url", "host", "__reel_part")),
             pa.array([[t for t, _ in b] for b in found], pa.list_(pa.string())),
             pa.array([[z for _, z in b] for b in found], pa.list_(pa.int32()))],
            names=["page_id", "url", "host", "__reel_part", "texts", "zones"])


_RESULT = "page_id bigint, url string, text string, n_chars bigint"


def _extract(table: pa.Table, repeated: pa.Table) -> pa.Table:
    """Texts of some pages of a host, given the host's repeated runs."""
    runs = repeated.column("run").to_numpy().view(np.uint64)
    strict = runs[repeated.column("strict").to_numpy().astype(bool)]
    out = []
    for page, zone in zip(table.column("texts").to_pylist(), table.column("zones").to_pylist(), strict=True):
        marked = max(zone, default=OPEN) > OPEN
        those = strict if marked else runs
        own = [t.split() for t in page]
        stream = [w for ws in own for w in ws]
        kept = np.repeat([z >= (MAIN if marked else OPEN) for z in zone], [len(ws) for ws in own]).astype(bool)
        left = kept
        if len(those) and len(stream) >= RUN:
            starts = np.zeros(len(stream), bool)
            starts[:len(stream) - RUN + 1] = np.isin(_run_hashes(stream), those)
            left = kept & ~cover(starts)
            if left.sum() < LEFT * kept.sum():
                left = kept
        out.append(" ".join(stream[i] for i in np.flatnonzero(left)))
    return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(out, pa.string()),
                     "n_chars": pa.array([len(t) for t in out], pa.int64())})


def _host_runs(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(host, run, strict): the repeated runs of every host, counted over all its pages."""
    contents = rows.select("host", "__reel_n", "html").mapInArrow(_contents, _CONTENTS)
    with shuffle_files_removed(rows.sparkSession):
        sent = contents.groupBy("host", "__reel_part").applyInArrow(_sent_runs, _SENT).checkpoint()
    totals = sent.where("run is null").groupBy("host").agg(F.sum("pages").alias("n"), F.sum("below").alias("_all"))
    need = F.greatest(F.lit(MIN_PAGES), F.ceil(F.lit(MIN_SHARE) * F.col("n"))).cast("bigint")
    judged = (sent.where("run is not null").groupBy("host", "run").agg(F.sum("pages").alias("pages"), F.sum("below").alias("_said"))
              .join(totals, "host").select("host", "run", "pages", need.alias("need"), (F.col("pages") + F.col("_all") - F.col("_said")).alias("most"))
              .where("most >= need").checkpoint())
    between = judged.where(f"pages < need or pages < {MARKED} * need and most >= {MARKED} * need")
    if not between.isEmpty():
        asked = between.select("host", "run").join(parts, F.col("host") == F.col("__reel_host"))
        asked = asked.select("host", F.explode(F.sequence(F.lit(0), F.col("__reel_n") - 1)).alias("__reel_part"), "run")
        some = rows.join(between.select("host").distinct(), "host", "left_semi").select("host", "__reel_n", "html").mapInArrow(_contents, _CONTENTS)
        with shuffle_files_removed(rows.sparkSession):
            counted = (some.groupBy("host", "__reel_part").cogroup(asked.groupBy("host", "__reel_part"))
                       .applyInArrow(_asked_runs, "host string, run bigint, pages bigint").groupBy("host", "run").agg(F.sum("pages").alias("_exact")).checkpoint())
        judged = judged.join(counted, ["host", "run"], "left").withColumn("pages", F.coalesce("_exact", "pages"))
    return judged.where("pages >= need").select("host", "run", (F.col("pages") >= MARKED * F.col("need")).alias("strict"))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) per row of ``pages``.

    Null, empty and textless pages give ''. Pages without a host (null or other
    urls) form one more host. Very long pages are read whole; one longer than a
    part has a part of its own or shares one. There are no ties: every run on
    enough pages goes. Repeated rows each get a row; other columns are
    ignored; an empty table gives an empty result. Neither the layout of the
    table nor the number of parts shows in the result.
    """
    prepare(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url"), host.alias("host"), "html")
    parts = (rows.groupBy("host").agg(F.ceil(F.sum(F.length("html")) / PART_CHARS).cast("int").alias("n"))
             .select(F.col("host").alias("__reel_host"), F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).alias("__reel_n")).checkpoint())
    parts = broadcast_if(parts, parts.count())
    rows = rows.join(parts, rows["host"] == parts["__reel_host"])
    repeated = _host_runs(rows, parts).join(parts, F.col("host") == F.col("__reel_host"))
    repeated = repeated.select("host", F.explode(F.sequence(F.lit(0), F.col("__reel_n") - 1)).alias("__reel_part"), "run", "strict")
    dealt = (rows.withColumn("__reel_part", F.pmod(F.xxhash64("page_id", "url", "html"), F.col("__reel_n")).cast("int"))
             .select("page_id", "url", "host", "__reel_part", "html"))
    return (dealt.mapInArrow(_parse, _BLOCKS).groupBy("host", "__reel_part").cogroup(repeated.groupBy("host", "__reel_part"))
            .applyInArrow(_extract, _RESULT))
