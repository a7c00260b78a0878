from __future__ import annotations

import random
from collections import Counter

from reelspark.llm.line_dedup import LONG_LINE, MIN_WORDS, chunks, dedup_lines, dedup_runs, drop_repeated_lines, removable, windows


def _brute(rows):
    """Repeated chunks by their bytes, over all rows."""
    first: dict = {}
    order = lambda d: (d is None, d or 0)
    for d, t in rows:
        raw = (t or "").encode()
        lines = raw.split(b"\n")
        for lo, hi, words in chunks(raw):
            if removable(lo, hi, words):
                key = b"\n".join(lines[lo:hi])
                first[key] = min(first.get(key, order(d)), order(d))
    out = Counter()
    for d, t in rows:
        if t is None:
            out[(d, None, 0, 0, 0)] += 1
            continue
        raw = t.encode()
        lines = raw.split(b"\n")
        kept, gone_lines, gone = [], 0, 0
        for lo, hi, words in chunks(raw):
            key = b"\n".join(lines[lo:hi])
            if removable(lo, hi, words) and first[key] < order(d):
                gone_lines += hi - lo
                gone += 1
            else:
                kept += lines[lo:hi]
        out[(d, b"\n".join(kept).decode(), len(lines) if raw else 0, gone_lines, gone)] += 1
    return out


def test_equals_brute_force(make_docs, sample_rows):
    passage = "\n".join(" ".join(f"p{i}w{j}" for j in range(9)) for i in range(12))
    long_line = " ".join(f"l{j}" for j in range(60))
    rows = sample_rows + [(8001, "intro one\n" + passage + "\nend"), (8002, "another start\nmore\n" + passage), (8003, "x\n" + long_line + "\ny"),
                          (8004, long_line), (8005, None), (8006, ""), (8007, "\n\n"), (None, long_line), (None, long_line),
                          (8008, long_line + "\n" + long_line), (8009, "short\nlines"), (8010, "short\nlines"), (8003, "x\n" + long_line + "\ny")]
    got = dedup_lines(make_docs(rows)).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed_lines, r.n_removed_chunks) for r in got) == _brute(rows)
    by = {r.doc_id: r for r in got}
    assert by[8002].n_removed_lines >= 4 and by[8001].n_removed_lines == 0  # the passage is found whatever stands before it
    assert by[8004].text == "" and by[8010].text == "short\nlines"
    assert by[8001].h == "x"


def test_chunks_cover_all_lines_in_order():
    for text in (b"", b"\n", b"a\nb\nc\n", b"w " * 40 + b"\nshort\n" + b"v " * 40):
        spans = chunks(text)
        assert [s for a, b, _ in spans for s in range(a, b)] == list(range(text.count(b"\n") + 1))


def test_empty_table(make_docs):
    assert dedup_lines(make_docs([])).count() == 0
    assert dedup_runs(make_docs([])).count() == 0 == drop_repeated_lines(make_docs([])).count()


def test_windows_are_linear_in_lines_without_words():
    words = b"one two three four five six seven eight nine ten"
    for blank in (b"", b" ", b"\t \t"):
        text = words + b"\n" + (blank + b"\n") * 100_000 + words + b"\n" + (blank + b"\n") * 3
        found = windows(text)
        assert len(found) <= 2 * (text.count(b"\n") + 1) and sum(len(c) for _, _, _, c in found) < 60 * text.count(b"\n")


def test_long_stretches_without_words(make_docs):
    rnd = random.Random(12)
    line = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    a, b = line(6), line(11)
    gaps = ["\n" * 5, "\n \n\n\t\n", "\n" * 4, "\n\n"]
    rows = [(i, f"{line(3)}\n{a}{gap}{b}{gap}{line(2)}") for i, gap in enumerate(gaps * 2)]
    rows += [(20 + i, f"{gap}{b}\n{line(4)}") for i, gap in enumerate(gaps)] + [(30 + i, f"{b}{gap}") for i, gap in enumerate(gaps)] + [(40, "\n" * 9), (41, "\n" * 9)]
    got = dedup_runs(make_docs(rows)).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed_lines) for r in got) == _brute_runs(rows)
    huge = a + "\n" * 100_000 + b + "\n" + line(5)
    got = {r.doc_id: r for r in dedup_runs(make_docs([(1, huge), (2, line(4) + "\n" + huge), (3, huge.rstrip("0123456789") + "x")])).collect()}
    assert got[1].n_removed_lines == 0 and got[2].n_removed_lines == 100_002 and got[3].n_removed_lines == 100_001


def _brute_runs(rows):
    """Every run of lines over the threshold that an earlier document has goes, by direct comparison."""
    order = lambda d: (d is None, d or 0)
    split = [(order(d), (t or "").split("\n")) for d, t in rows]
    out = Counter()
    for (o, lines), (d, t) in zip(split, rows, strict=True):
        gone = [False] * len(lines)
        for o2, other in split:
            if o2 < o:
                for i in range(len(lines)):
                    for j in range(len(other)):
                        if lines[i] == other[j] and not (i and j and lines[i - 1] == other[j - 1]):
                            n = 0
                            while i + n < len(lines) and j + n < len(other) and lines[i + n] == other[j + n]:
                                n += 1
                            long = any(len(x.split()) >= LONG_LINE for x in lines[i:i + n])
                            if n > 1 and sum(len(x.split()) for x in lines[i:i + n]) >= MIN_WORDS or long:
                                gone[i:i + n] = [True] * n
        kept = [x for x, g in zip(lines, gone, strict=True) if not g]
        out[(d, t if t is None else "\n".join(kept), len(lines) if t else 0, sum(gone))] += 1
    return out


def test_repeated_runs_go_whole_wherever_chunks_end(make_docs):
    rnd = random.Random(9)
    line = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    rows = [(900, None), (901, ""), (902, "a\nb"), (903, "a\nb"), (904, "x\n" + line(25) + "\ny")]
    rows += [(905, "é " + rows[-1][1].split("\n")[1]), (906, "z\n" + rows[-1][1].split("\n")[1]), (None, rows[-1][1])]
    for p in range(40):
        passage = "\n".join(line(rnd.randint(8, 15)) for _ in range(rnd.randint(5, 12)))
        rows += [(10 * p, f"{line(6)}\n{passage}\n{line(7)}\n{line(3)}"), (10 * p + 1, f"{line(9)}\n{line(4)}\n{passage}\n{line(5)}")]
    few = [["", "one", "two three", "four five six seven", "a b c d e f g h i j", line(20)][rnd.randrange(6)] for _ in range(300)]
    rows += [(600 + i, "\n".join(few[12 * i:12 * i + 12])) for i in range(25)] + [(600, "\n".join(few[40:50])), (None, "\n".join(few[:30]))]
    got = dedup_runs(make_docs(rows)).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed_lines) for r in got) == _brute_runs(rows)
    copies = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 10 == 1]
    assert all(r.n_removed_chunks == 1 and r.n_lines - r.n_removed_lines == 3 for r in copies)
    left = {r.doc_id: r.text for r in drop_repeated_lines(make_docs(rows[:-2])).collect()}
    assert all(left[r.doc_id] == r.text for r in copies)
