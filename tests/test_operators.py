"""Distributed operators against brute force on small inputs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import indexing, scoring, similarity as sim


def test_global_row_number_equals_row_number(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = indexing.global_row_number(df, [F.col("a").desc(), F.col("b").asc()], "pos", partitions=7).collect()
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted((r["pos"], r["a"], r["b"]) for r in got) == [(i, a, b) for i, (a, b) in enumerate(want)]


@pytest.mark.parametrize("total,buckets", [(1, 100), (7, 3), (250, 100), (1000, 100), (99, 100)])
def test_ntile_formula(spark, duck, total, buckets):
    want = [r[0] for r in duck.execute(
        f"select ntile({buckets}) over (order by i) from range({total}) t(i) order by i").fetchall()]
    df = spark.range(total).select(indexing.ntile_from_position(F.col("id"), total, buckets).alias("b"))
    assert [r["b"] for r in df.orderBy(F.monotonically_increasing_id()).collect()] == want


def test_next_user_index(spark):
    old = spark.createDataFrame([(10, 0), (20, 1)], "uid long, user_idx long")
    new = spark.createDataFrame([(20,), (15,), (30,), (15,)], "uid long")
    got = sorted(map(tuple, indexing.next_user_index(old, new, "uid", "user_idx").collect()))
    assert got == [(15, 2), (30, 3)]


def _brute_cos(vecs):
    ids = sorted(vecs)
    out = {}
    for a in ids:
        for b in ids:
            if a == b:
                continue
            va, vb = np.asarray(vecs[a], float), np.asarray(vecs[b], float)
            na, nb = np.linalg.norm(va), np.linalg.norm(vb)
            if na and nb:
                out[(a, b)] = float(va @ vb / (na * nb))
    return out


def test_sparse_cosine_matches_brute_force(spark):
    rnd = random.Random(5)
    terms = [f"t{i}" for i in range(12)]
    entries, vecs = [], {}
    for doc in range(60):
        chosen = rnd.sample(terms, rnd.randint(1, 4)) if doc % 7 else ["t0", "t1"]  # repeated vectors
        v = np.zeros(len(terms))
        for t in chosen:
            w = 1.0 if doc % 7 == 0 else float(rnd.randint(1, 3))
            entries.append((doc, t, w))
            v[terms.index(t)] = w
        vecs[doc] = v
    df = spark.createDataFrame(entries, "mid long, term string, w double")
    for t in (0.3, 0.6, 0.9):
        got = {(r["mid"], r["sim_mid"]): r["score"] for r in sim.sparse_cosine_pairs(df, t).collect()}
        want = {k: v for k, v in _brute_cos(vecs).items() if v > t + 1e-12}
        assert set(got) == set(want), t
        assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_dense_cosine_matches_brute_force(spark, block_rows):
    rng = np.random.default_rng(2)
    vecs = {i: rng.normal(size=5).tolist() for i in range(40)}
    vecs[40] = [0.0] * 5  # zero vector is skipped
    df = spark.createDataFrame([(k, v) for k, v in vecs.items()], "vid long, v array<double>")
    brute = _brute_cos(vecs)
    got = {(r["vid"], r["sim_id"]): r["score"]
           for r in sim.dense_cosine_pairs(df, "vid", "v", threshold=0.5, block_rows=block_rows).collect()}
    want = {k: v for k, v in brute.items() if v > 0.5}
    assert set(got) == set(want)
    top = sim.dense_cosine_pairs(df, "vid", "v", k=3, block_rows=block_rows).collect()
    for i in range(40):
        mine = [r["sim_id"] for r in sorted((r for r in top if r["vid"] == i), key=lambda r: r["rank"])]
        ref = sorted((b for (a, b) in brute if a == i), key=lambda b: (-brute[(i, b)], b))[:3]
        assert mine == ref


def test_dense_cosine_symmetric(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)], "vid long, v array<double>")
    got = {(r["vid"], r["sim_id"]): r["score"]
           for r in sim.dense_cosine_pairs(df, "vid", "v", threshold=0.0, block_rows=8).collect()}
    assert all(math.isclose(s, got[(b, a)], abs_tol=1e-12) for (a, b), s in got.items())


def test_ncf_tiny_forward_by_hand(spark):
    layers = scoring.NCFLayers(
        weights=[np.full((64, 16), 0.01), np.full((32, 64), 0.02), np.full((8, 32), 0.03)],
        biases=[np.zeros(64), np.zeros(32), np.zeros(8)], out_w=np.full(16, 0.5), out_b=-0.1)
    users = spark.createDataFrame([(0, [1.0] * 8, [0.5] * 8), (1, [0.0] * 8, [1.0] * 8)],
                                  "user_idx long, u_mlp array<double>, u_gmf array<double>")
    items = spark.createDataFrame([(0, [2.0] * 8, [2.0] * 8)], "item_idx long, i_mlp array<double>, i_gmf array<double>")
    pairs = spark.createDataFrame([(0, 0), (1, 0)], "user_idx long, item_idx long")
    got = {r["user_idx"]: r["score"] for r in scoring.score_pairs(pairs, users, items, layers).collect()}

    def by_hand(u, i, ug, ig):
        h1 = 0.01 * (8 * u + 8 * i)          # every unit of layer 1
        h2 = 0.02 * 64 * h1
        h3 = 0.03 * 32 * h2
        z = 0.5 * 8 * h3 + 0.5 * 8 * (ug * ig) - 0.1
        return 1 / (1 + math.exp(-z))
    assert math.isclose(got[0], by_hand(1.0, 2.0, 0.5, 2.0), rel_tol=1e-12)
    assert math.isclose(got[1], by_hand(0.0, 2.0, 1.0, 2.0), rel_tol=1e-12)


def test_blocked_lists_match_brute_force(spark, monkeypatch):
    from reelspark.operators import als
    monkeypatch.setattr(als, "USER_BLOCK", 2)
    monkeypatch.setattr(als, "ITEM_BLOCK", 5)
    rnd = random.Random(8)
    uv = {u: [rnd.gauss(0, 1) for _ in range(3)] for u in range(9)}
    iv = {i: [rnd.gauss(0, 1) for _ in range(3)] for i in range(23)}
    iv[7] = iv[3]  # a tie
    factors = als.Factors(spark.createDataFrame(list(uv.items()), "uid long, features array<double>"),
                          spark.createDataFrame(list(iv.items()), "mid long, features array<double>"))
    had = {(u, i) for u in range(9) for i in range(23) if rnd.random() < 0.3}
    seen = spark.createDataFrame([*had, (1, 99), (77, 1)], "uid long, mid long")
    for given, without in ((None, set()), (seen, had)):
        got = als.user_recs(factors, 4, given).collect()
        for u in range(9):
            mine = [r["mid"] for r in sorted((r for r in got if r["uid"] == u), key=lambda r: r["rank"])]
            score = {i: float(np.dot(uv[u], iv[i])) for i in iv if (u, i) not in without}
            assert mine == [i for i in sorted(score, key=lambda i: (-round(score[i], 9), i)) if score[i] > 0][:4]


def test_fallback_lists_for_users_far_down_the_list(spark):
    from reelspark.operators.serving import stream_fallback
    popular = spark.createDataFrame([(i, 100 - i) for i in range(30)], "mid long, count long")
    rated = spark.createDataFrame([(1, i) for i in range(18)] + [(2, 0), (2, 3)], "uid long, mid long")
    own = spark.createDataFrame([(4, 5, 0.5), (4, 6, 0.9)], "uid long, mid long, score double")
    users = spark.createDataFrame([(u,) for u in (1, 2, 3, 4)], "uid long")
    for head in (2, 1000):
        lists: dict = {}
        for r in sorted(stream_fallback(own, popular, rated, users, 4, head).collect(), key=lambda r: r["rank"]):
            lists.setdefault(r["uid"], []).append(r["mid"])
        assert lists == {1: [18, 19, 20, 21], 2: [1, 2, 4, 5], 3: [0, 1, 2, 3], 4: [6, 5]}


def test_grouped_top_k_equals_expanded_top_k(spark):
    rnd = random.Random(11)
    terms = [f"t{i}" for i in range(6)]
    entries = []
    for doc in range(50):
        chosen = ["t0", "t1"] if doc % 3 == 0 else rnd.sample(terms, rnd.randint(1, 3))
        entries += [(doc, t, 1.0) for t in chosen]
    g = sim.sparse_cosine_groups(spark.createDataFrame(entries, "mid long, term string, w double"), 0.3)
    got = sorted((r["mid"], r["rank"], r["sim_mid"]) for r in g.top_k(4).collect())
    pairs = [(r["mid"], r["sim_mid"], r["score"]) for r in g.expand().collect()]
    want = []
    for m in sorted({p[0] for p in pairs}):
        mine = sorted((p for p in pairs if p[0] == m), key=lambda p: (-round(p[2], 9), p[1]))[:4]
        want += [(m, i + 1, p[1]) for i, p in enumerate(mine)]
    assert got == sorted(want)


def test_sparse_groups_do_not_depend_on_partitions(spark, sf_dir):
    """The same bits whatever the shuffle order: members, representatives and scores."""
    from reelspark.operators import similarity as sim
    from reelspark.sources import driver_tables as src
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "8", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            t = sim.tfidf(sim.genre_terms(src.items(spark, sf_dir).repartition(int(n))))
            g = sim.sparse_cosine_groups(t.select("mid", "term", "w"), 0.6)
            found.append((sorted(map(tuple, g.members.collect())), sorted(map(tuple, g.rep_pairs.collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]
    members, pairs = found[0]
    assert {r for _, r in members} == {a for a, b, _ in pairs if a == b}


def _brute_cosine(rows, threshold=None, k=None):
    import numpy as np
    kept = [(i, np.array(v, float)) for i, v in rows if any(v)]
    out = []
    for i, a in kept:
        found = sorted((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 9), j) for j, b in kept if i != j)
        out += [(i, j, -s) for s, j in [f for f in found if threshold is None or -f[0] > threshold][:k]]
    return sorted(out)


@pytest.mark.parametrize(("threshold", "k"), [(0.6, None), (0.6, 4), (None, 4), (0.95, None)])
def test_dense_cosine_with_clusters_and_equal_vectors(spark, threshold, k):
    import numpy as np

    from reelspark.operators.similarity import dense_cosine_pairs
    r = np.random.default_rng(3)
    centres = r.normal(size=(8, 6))
    rows = [(int(i) * 3, (centres[i % 8] + 0.1 * r.normal(size=6)).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[5][1]) for i in range(12)] + [(2000 + i, rows[9][1]) for i in range(3)] + [(3000, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(5)
    got = dense_cosine_pairs(df, "id", "v", threshold=threshold, k=k, block_rows=20)
    assert sorted((x["id"], x.sim_id, round(x.score, 9)) for x in got.collect()) == _brute_cosine(rows, threshold, k)


def test_block_pairs_are_pruned_and_none_that_matters(spark, sf_dir):
    import numpy as np

    from reelspark.operators.similarity import direction_blocks
    r = np.random.default_rng(4)
    centres = r.normal(size=(30, 16))
    v = centres[r.integers(0, 30, 900)] + 0.1 * r.normal(size=(900, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    blocks = direction_blocks(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "_id bigint, _v array<double>"), 900, 30)
    every, left = blocks.number * (blocks.number + 1) // 2, {tuple(x) for x in blocks.pairs(0.6).collect()}
    assert len(left) < 0.6 * every  # clustered vectors: over two fifths of the block pairs are skipped
    block_of = {int(i): x["_blk"] for x in blocks.packed.collect() for i in np.frombuffer(x["ids"], np.int64)}
    assert len(block_of) == 900
    for a, b in zip(*np.nonzero(v @ v.T > 0.6)):
        assert tuple(sorted((block_of[int(a)], block_of[int(b)]))) in left


def test_factorised_top_k_ranks_groups_not_items(spark):
    """Every item was ranked against the members of all partner groups; a group's list is now ranked once and its members leave themselves out."""
    from reelspark.operators.similarity import GroupedPairs
    reps = {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6}
    scores = {(0, 4): 0.9, (0, 6): 0.7, (4, 6): 0.8}
    scores |= {(b, a): s for (a, b), s in scores.items()} | {(a, a): 1.0 for a in (0, 4, 6)}
    g = GroupedPairs(spark.createDataFrame(list(reps.items()), "mid bigint, _rep bigint"), spark.createDataFrame([(*p, s) for p, s in scores.items()], "_a bigint, _b bigint, score double"))
    top = g.top_k(3)
    want = {(m, r, o, s) for m in reps for r, (s, o) in enumerate(sorted(((scores[reps[m], reps[o]], o) for o in reps if o != m), key=lambda x: (-x[0], x[1]))[:3], 1)}
    assert {(x.mid, x.rank, x.sim_mid, x.score) for x in top.collect()} == want
    assert "Window [row_number() windowspecdefinition(mid" not in top._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cells", [1, 40, 1 << 22])
def test_most_frequent_genres(cells):
    """Genres of a history were sorted and searched row by row; they are counted by batches, with the same order."""
    import pyarrow as pa
    from collections import Counter
    from reelspark.operators.features import _most_frequent
    rnd = random.Random(3)
    rows = [["|".join(rnd.choices(["x", "B", "b", "", "\u00e9", "zz", "\U0001f600"], k=rnd.randint(1, 5))) for _ in range(rnd.randint(0, 6))] for _ in range(60)]
    want = [[g for g, _ in sorted(Counter(t for s in r for t in s.split("|")).items(), key=lambda x: (-x[1], x[0]))][:5] for r in rows]
    assert _most_frequent(pa.array(rows, pa.list_(pa.string())).slice(3), 5, cells).to_pylist() == want[3:]
    assert _most_frequent(pa.array([[], []], pa.list_(pa.string())), 5, cells).to_pylist() == [[], []]
