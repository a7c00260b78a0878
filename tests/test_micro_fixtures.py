"""Literal fixtures for each deliberate semantic choice."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from reelspark.functions.columns import clean_title, release_year
from reelspark.operators import features as fe
from reelspark.operators import serving, stats
from reelspark.operators.topk import top_k_per_group
from reelspark.operators.upsert import merge_latest
from reelspark.operators.windows import key_positions
from reelspark.streaming import rerank as rr

RATING = "uid long, mid long, score double, ts long"


def test_ties_break_on_id(spark):
    df = spark.createDataFrame([(1, 5, 2.0), (1, 3, 2.0), (1, 4, 2.0), (1, 9, 1.0)], "g long, mid long, v double")
    out = top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("mid").asc()], 2).orderBy("rank").collect()
    assert [(r["mid"], r["rank"]) for r in out] == [(3, 1), (4, 2)]


def _samples(spark, n, uid=7):
    rows = [(uid, m, float(1 + m % 10) / 2, 1000 + m, 1 if (1 + m % 10) / 2 >= 3.5 else 0,
             "Drama|Comedy" if m % 2 else "Drama", 1990 + m % 7) for m in range(n)]
    return spark.createDataFrame(
        rows, "uid long, mid long, score double, ts long, label int, genres string, release_year int")


def test_first_row_has_empty_history(spark):
    out = fe.sample_user_features(_samples(spark, 3)).orderBy("ts").collect()
    first = out[0]
    assert first["user_rating_count"] == 0
    assert first["user_avg_rating"] is None and first["user_rating_stddev"] is None
    assert first["user_rated_movie1"] is None and first["user_genre1"] is None
    assert out[1]["user_rating_stddev"] is None  # one preceding row: sample stddev is null


def test_frame_cut_at_100(spark):
    df = _samples(spark, 105)
    out = {r["mid"]: r for r in fe.sample_user_features(df).collect()}
    scores = [float(1 + m % 10) / 2 for m in range(105)]
    assert out[100]["user_rating_count"] == 100
    assert math.isclose(out[100]["user_avg_rating"], sum(scores[:100]) / 100)
    assert out[104]["user_rating_count"] == 100
    assert math.isclose(out[104]["user_avg_rating"], sum(scores[4:104]) / 100)


@pytest.mark.parametrize("chunk", [3, 7, 50])
def test_sliding_frame_chunks_equal_plain_window(spark, chunk):
    from pyspark.sql import Window

    from reelspark.operators.windows import sliding_frame

    df = _samples(spark, 60).unionByName(_samples(spark, 5, uid=8))
    width = 3

    def cols(w):
        w = w.rowsBetween(-width, -1)
        return [F.count(F.lit(1)).over(w).alias("n"), F.sum("score").over(w).alias("s"),
                F.collect_list("mid").over(w).alias("h")]

    chunked = sliding_frame(df, "uid", ["ts", "mid"], width, cols, chunk_rows=chunk).drop("_p")
    plain = df.select("*", *cols(Window.partitionBy("uid").orderBy("ts", "mid")))
    assert sorted(map(tuple, chunked.collect())) == sorted(map(tuple, plain.collect()))


def test_hot_user_full_features_match(spark):
    df = _samples(spark, 230).unionByName(_samples(spark, 12, uid=9))
    plain = sorted(map(tuple, fe.sample_user_features(df).collect()))
    chunked = sorted(map(tuple, fe.sample_user_features(df, chunk_rows=100).collect()))
    assert plain == chunked


def test_key_positions(spark):
    df = spark.createDataFrame([(1, t) for t in range(40)] + [(2, t) for t in range(3)], "k long, t long")
    a = sorted(map(tuple, key_positions(df, "k", ["t"], "pos").collect()))
    assert a == sorted([(1, t, t) for t in range(40)] + [(2, t, t) for t in range(3)])


def test_duplicate_genre_one_index(spark):
    items = spark.createDataFrame([(1, "x", "Drama|Drama"), (2, "y", "Drama|Comedy")], "mid long, title string, genres string")
    gi = fe.genre_frequency_index(items)
    mh = fe.multi_hot_genres(items, gi).collect()
    assert sorted((r["mid"], r["genre_idx"]) for r in mh) == [(1, 0), (2, 0), (2, 1)]
    assert {r["genre"]: r["genre_idx"] for r in gi.collect()} == {"Drama": 0, "Comedy": 1}


def test_titles(spark):
    df = spark.createDataFrame([(None,), ("Up",), ("No year here",), ('Heat, The (1995)',), ("Toy Story (1995) ",)],
                               "title string")
    out = df.select(release_year(F.col("title")).alias("y1"), release_year(F.col("title"), -1).alias("y2"),
                    clean_title(F.col("title")).alias("t")).collect()
    assert [r["y1"] for r in out] == [1990, 1990, 1990, 1995, 1995]
    assert [r["y2"] for r in out] == [-1, -1, -1, 1995, 1995]
    assert [r["t"] for r in out] == [None, "Up", "No year here", "Heat, The", "Toy Story"]


def test_bad_lines_dropped(spark):
    lines = spark.createDataFrame(
        [("x MOVIE_RATING_PREFIX:1|2|3.5|100",), ("x MOVIE_RATING_PREFIX:1|2|abc|100",),
         ("x MOVIE_RATING_PREFIX:1|2|3.5",), ("INFO web : click",), ("MOVIE_RATING_PREFIX: 4 | 5 | 1.0 | 7 ",)],
        "line string")
    out = rr.parse_messages(rr.filter_log(lines)).select("uid", "mid", "score", "ts").collect()
    assert sorted(map(tuple, out)) == [(1, 2, 3.5, 100), (4, 5, 1.0, 7)]


def _sims(spark, rows):
    return spark.createDataFrame(rows, "mid long, sim_mid long, score double")


def test_rerank_score_formula(spark):
    sims = _sims(spark, [(10, 1, 0.9), (10, 2, 0.8), (10, 3, 0.5)])
    cands = spark.createDataFrame([(1, 10)], "uid long, mid long")
    recents = spark.createDataFrame([(1, 1, 5.0), (1, 2, 2.0), (1, 3, 4.0)], "uid long, mid long, score double")
    r = rr.candidate_scores(cands, recents, sims).collect()
    assert len(r) == 1 and math.isclose(r[0]["score"], 3.05, abs_tol=1e-9)
    sims2 = _sims(spark, [(10, 1, 0.9), (10, 2, 0.8), (10, 3, 0.75)])
    r2 = rr.candidate_scores(cands, recents, sims2).collect()
    assert math.isclose(r2[0]["score"], (4.5 + 1.6 + 3.0) / 3 + math.log10(2), abs_tol=1e-9)
    assert round(r2[0]["score"], 6) == 3.334363


def test_missing_similarity_row_gives_no_candidates(spark):
    sims = _sims(spark, [(10, 1, 0.9)])
    last = spark.createDataFrame([(1, 99)], "uid long, mid long")
    seen = spark.createDataFrame([(1, 99)], "uid long, mid long")
    assert rr.candidates(last, seen, sims).count() == 0


def test_candidates_exclude_seen_and_cap(spark):
    sims = _sims(spark, [(5, m, 0.9 - m / 100) for m in range(20)])
    last = spark.createDataFrame([(1, 5)], "uid long, mid long")
    seen = spark.createDataFrame([(1, 5), (1, 0), (1, 3)], "uid long, mid long")
    got = [r["mid"] for r in rr.candidates(last, seen, sims).orderBy("rank").collect()]
    assert got == [1, 2, 4, 6, 7, 8, 9, 10, 11, 12]


def test_upsert_last_write_wins_and_replay(spark):
    base = spark.createDataFrame([(1, 2, 3.0, 10)], RATING)
    ch = spark.createDataFrame([(1, 2, 4.0, 20), (1, 2, 1.0, 15), (2, 2, 5.0, 1)], RATING)
    once = merge_latest(base, ch, ["uid", "mid"], ["ts"], ["score"])
    twice = merge_latest(once, ch, ["uid", "mid"], ["ts"], ["score"])
    assert sorted(map(tuple, once.select("uid", "mid", "score", "ts").collect())) == [(1, 2, 4.0, 20), (2, 2, 5.0, 1)]
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_cold_start_union(spark):
    prefs = spark.createDataFrame([(1, "A"), (1, "B")], "uid long, genre string")
    top = spark.createDataFrame([("A", 1, 10, 4.0), ("A", 2, 11, 3.0), ("B", 1, 10, 4.0), ("B", 2, 12, 3.5),
                                 ("C", 1, 13, 5.0)], "genre string, rank long, mid long, avg double")
    got = serving.cold_start(prefs, top).orderBy("rank").collect()
    assert [(r["mid"], r["score"]) for r in got] == [(10, 4.0), (12, 3.5), (11, 3.0)]
    assert serving.cold_start(prefs.where("uid = 2"), top).count() == 0


def test_genre_containment(spark):
    items = spark.createDataFrame([(1, "t", "Action|Drama"), (2, "t", "Dramatic|War"), (3, "t", "war")],
                                  "mid long, title string, genres string")
    avgs = spark.createDataFrame([(1, 4.0), (2, 3.0), (3, 2.0)], "mid long, avg double")
    genres = spark.createDataFrame([("Drama",), ("WAR",), ("Sci-Fi",)], "genre string")
    a = sorted((r["genre"], r["mid"], r["rank"]) for r in stats.genre_top_n(items, avgs, genres).collect())
    assert a == [("Drama", 1, 1), ("Drama", 2, 2), ("WAR", 2, 1), ("WAR", 3, 2)]


def test_stream_fallback_matches_brute_force(spark):
    import random
    rnd = random.Random(3)
    ratings = [(u, m, 1.0, 0) for u in range(6) for m in range(30) if rnd.random() < 0.4]
    rated = spark.createDataFrame(ratings, RATING)
    pop = stats.most_rated(rated)
    users = spark.createDataFrame([(u,) for u in range(7)], "uid long")
    lists = spark.createDataFrame([(0, 1, 100, 9.0)], "uid long, rank long, mid long, score double")
    got = serving.stream_fallback(lists.drop("rank"), pop, rated, users, size=10)
    got = sorted((r["uid"], r["rank"], r["mid"]) for r in got.collect())
    counts = {}
    for _, m, _, _ in ratings:
        counts[m] = counts.get(m, 0) + 1
    order = sorted(counts, key=lambda m: (-counts[m], m))
    want = [(0, 1, 100)]
    for u in range(1, 7):
        seen = {m for uu, m, _, _ in ratings if uu == u}
        free = [m for m in order if m not in seen][:10]
        want += [(u, i + 1, m) for i, m in enumerate(free)]
    assert got == sorted(want)


def test_unknown_item_and_unrated_item(spark):
    ratings = spark.createDataFrame([(1, 999, 4.0, 10), (1, 1, 3.0, 5)], RATING)
    items = spark.createDataFrame([(1, "Heat (1995)", "Action|Crime"), (2, "No year", "Drama")],
                                  "mid long, title string, genres string")
    s = {r["mid"]: r for r in fe.sample_item_features(ratings, items).collect()}
    assert s[999]["title"] is None and s[999]["release_year"] == 1990 and s[999]["movie_genre1"] is None
    assert s[999]["movie_rating_count"] == 1 and s[999]["label"] == 1
    assert s[1]["release_year"] == 1995 and s[1]["movie_genre2"] == "Crime" and s[1]["movie_genre3"] is None
    p = {r["mid"]: r for r in serving.item_profile(items, ratings).collect()}
    assert (p[2]["rating_count"], p[2]["avg_rating"], p[2]["release_year"]) == (0, 0.0, -1)
    assert 999 not in p
    users = spark.createDataFrame([(1, "a"), (2, "b")], "uid long, username string")
    u = {r["uid"]: r for r in serving.user_profile(users, ratings).collect()}
    assert (u[1]["lowest_rating"], u[1]["highest_rating"]) == (3.0, 4.0)
    assert (u[2]["rating_count"], u[2]["avg_rating"], u[2]["lowest_rating"]) == (0, 0.0, 0.0)


def test_fallback_hydrate_lookup_links(spark):
    lfm = spark.createDataFrame([(1, 1, 10, 0.9)], "uid long, rank long, mid long, score double")
    cold = spark.createDataFrame([(1, 1, 20, 4.0), (2, 1, 21, 3.0), (3, 1, 22, 2.0)],
                                 "uid long, rank long, mid long, score double")
    users = spark.createDataFrame([(1, "a"), (2, "b")], "uid long, username string")
    out = sorted(map(tuple, serving.recs_with_fallback(lfm, cold, users).collect()))
    assert out == [(1, 1, 10, 0.9), (2, 1, 21, 3.0)]  # user 3 is not a known user
    items = spark.createDataFrame([(10, "Heat (1995)", "Action"), (21, "Up (2009)", "Kids")],
                                  "mid long, title string, genres string")
    h = serving.hydrate(lfm, items.select("mid", "title"), "mid", "mid").first()
    assert (h["rank"], h["title"]) == (1, "Heat (1995)")
    assert serving.lookup(items, "mid", 21).first()["title"] == "Up (2009)"
    assert serving.lookup(items, "mid", 99).count() == 0
    links = spark.createDataFrame([(10, "0113277", "949")], "mid long, imdbId string, tmdbId string")
    ratings = spark.createDataFrame([], RATING)
    p = {r["mid"]: r for r in serving.item_profile(items, ratings, links).collect()}
    assert p[10]["imdbId"] == "0113277" and p[21]["imdbId"] is None


def test_guarded_cosine(spark):
    from reelspark.functions.columns import guarded_cosine
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0], [1.0, 2.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r[0] for r in df.select(guarded_cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0, -1.0]
