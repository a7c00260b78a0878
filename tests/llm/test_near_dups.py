from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from reelspark.llm.components import connected_components
from reelspark.llm.near_dups import drop_near_duplicates, near_duplicates


def _sets(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def _brute(rows, percent):
    sets = _sets(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(o for x in s for o in where[x])
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                parent[find(i)] = find(o)
        for x in s:
            where[x].append(i)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def _near_copies(n, base_words=200, edits=6, seed=3):
    """Copies of one text with a few words changed: star-shaped similarity, many cross pairs below the threshold."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(base_words)]
    out = []
    for i in range(n):
        words = list(base)
        for p in rnd.sample(range(base_words), rnd.randrange(edits + 1)):
            words[p] = f"x{i}_{p}"
        out.append((1000 + i, " ".join(words)))
    return out


@pytest.mark.parametrize("percent", [85, 80])
def test_components_equal_brute_force(make_docs, sample_rows, percent):
    rows = sample_rows + _near_copies(60) + [
        (None, "a b c d e f g"), (None, "a b c d e f g"), (5001, "A B C D E F G"), (5002, "one two"), (5003, "One  two"), (5004, ""),
        (5005, None), (5006, " \n\t"), (5007, "one"), (5007, "one"), (5008, "a b"), (5009, "word " * 3000)]
    got = near_duplicates(make_docs(rows), percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _brute(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_stage_keeps_one_row_of_each_group(make_docs):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (3, ""), (3, ""), (4, None), (None, "x y z"), (None, "x y z")]
    docs = make_docs(rows)
    got = drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(
        [(1, "a b c d e f"), (3, ""), (3, ""), (4, None), (None, "x y z")])


def test_stage_keeps_different_texts_under_one_doc_id_or_none(make_docs):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (1, "one two three"), (None, "k l m n o"), (None, "p q r s t"),
            (None, "P q r s t"), (None, "one two three"), (7, "a b c d e f"), (7, "g h i j k l m")]
    got = Counter((r.doc_id, r.text.lower()) for r in drop_near_duplicates(make_docs(rows)).collect())
    assert got == Counter([(1, "a b c d e f"), (1, "u v w x y z"), (1, "one two three"), (None, "k l m n o"), (None, "p q r s t"),
                           (7, "g h i j k l m")])


def test_stage_tells_linked_components_apart(make_docs):
    left, right = ([(d, t) for d, (_, t) in zip(ids, _near_copies(4, edits=2, seed=seed), strict=True)]
                   for seed, ids in ((5, (20, 21, 22, 23)), (6, (20, 31, 32, 33))))
    none = [(None, t) for _, t in _near_copies(4, edits=2, seed=7)]
    got = Counter(r.doc_id for r in drop_near_duplicates(make_docs(left + right + none + [(None, "some other text")])).collect())
    assert got == Counter({20: 2, None: 2})


def test_empty_table(make_docs):
    assert near_duplicates(make_docs([]), 85).count() == 0


def test_components_of_random_graphs(spark):
    rnd = random.Random(5)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(30)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
    assert {r.node for r in got} == {x for a, b in links if a != b for x in (a, b)}
    assert len(got) == len({r.node for r in got}) and all(r.component == find(r.node) for r in got)
