"""Serving queries as batch operators over all users and items.

The reference answers these per request from an in-memory cache; here each
one is a DataFrame over every user or item, with a rank column where the
request had a list size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.columns import (DEFAULT_RELEASE_YEAR_CATALOGUE, PREF_GENRE_THRESHOLD, clean_title,
                                         release_year, split_genres)
from reelspark.operators.indexing import global_row_number
from reelspark.operators.requests import segments
from reelspark.operators.topk import top_k_per_group
from reelspark.operators.windows import key_positions

# List sizes of the reference's pages and profiles.
BROWSE_SIZE = 16
TOP_RATINGS = 10
COLD_START_SIZE = 10
STREAM_LIST_SIZE = 10

HISTORY_SEGMENT = 1000

#: First positions of the popularity list that are looked up in an array; results do not depend on it.
POPULAR_HEAD = 1000


def item_profile(items: DataFrame, ratings: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Catalogue row with rating count and mean (0 when unrated),
    the release year (-1 when the title has none) and, when a links table is
    given, the external ids (left join: items without links keep nulls)."""
    agg = ratings.groupBy("mid").agg(F.count(F.lit(1)).alias("rating_count"), F.avg("score").alias("avg_rating"))
    out = (items.join(agg, "mid", "left")
           .select("mid", clean_title(F.col("title")).alias("title"), "genres",
                   release_year(F.col("title"), DEFAULT_RELEASE_YEAR_CATALOGUE).alias("release_year"),
                   F.coalesce("rating_count", F.lit(0)).cast("bigint").alias("rating_count"),
                   F.coalesce("avg_rating", F.lit(0.0)).alias("avg_rating")))
    if links is not None:
        out = out.join(links.select("mid", "imdbId", "tmdbId"), "mid", "left")
    return out


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The first row whose ``key`` equals ``value`` (a point lookup; on a
    table written by ``sinks.write_table(key=...)`` parquet statistics prune
    row groups). The batch form of many lookups is an equi-join."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def hydrate(ranked: DataFrame, rows: DataFrame, id_col: str, key: str) -> DataFrame:
    """Replace ids in a ranked list by their rows (left join on the id;
    the rank column keeps the list order)."""
    return ranked.join(rows.withColumnRenamed(key, id_col), id_col, "left")


def item_top_ratings(ratings: DataFrame, k: int = TOP_RATINGS) -> DataFrame:
    """The k highest ratings of each item; ties keep the earlier rating
    (ts asc, then user id). Partial top-k before the shuffle."""
    return top_k_per_group(ratings.select("mid", "uid", "score", "ts"), ["mid"],
                           [F.col("score").desc(), F.col("ts").asc(), F.col("uid").asc()], k)


def user_profile(users: DataFrame, ratings: DataFrame) -> DataFrame:
    """Count, mean, highest and lowest score per user (true minimum;
    zeros when the user has no rating)."""
    agg = ratings.groupBy("uid").agg(F.count(F.lit(1)).alias("rating_count"), F.avg("score").alias("avg_rating"),
                                     F.max("score").alias("highest_rating"), F.min("score").alias("lowest_rating"))
    return users.join(agg, "uid", "left").select(
        "uid", "username", F.coalesce("rating_count", F.lit(0)).cast("bigint").alias("rating_count"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_rating", "highest_rating", "lowest_rating")])


def user_history(ratings: DataFrame, size: int = HISTORY_SEGMENT) -> DataFrame:
    """Q12: each user's ratings in order of (ts, mid), in segments of at most
    ``size``: (uid, segment, n, first_ts, last_ts, ratings), ratings being the
    JSON list the profile carries. A user with very many ratings has many
    segments and no large row; a reader takes the segments it needs."""
    parts = segments(ratings.select("uid", "ts", "mid", "score"), "uid", ["ts", "mid"], size, "segment")
    listed = parts.groupBy("uid", "segment").agg(F.array_sort(F.collect_list(F.struct("ts", "mid", "score"))).alias("_l"))
    entry = lambda r: F.struct(F.struct(r["mid"].alias("mid"), r["score"].alias("score"), r["ts"].alias("timestamp")).alias("rating"))
    return listed.select("uid", "segment", F.size("_l").cast("bigint").alias("n"), F.array_min("_l.ts").alias("first_ts"), F.array_max("_l.ts").alias("last_ts"),
                         F.to_json(F.transform("_l", entry)).alias("ratings"))


def lookup_many(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """P11 for many keys: the rows of ``table`` whose ``key`` is among
    ``keys`` (each key once). On a table written by ``sinks.write_bucketed``
    the table side is read bucket by bucket, without a shuffle."""
    return keys.select(key).distinct().join(table.hint("shuffle_merge"), key)


def derived_pref_genres(ratings: DataFrame, items: DataFrame,
                        threshold: float = PREF_GENRE_THRESHOLD) -> DataFrame:
    """Distinct genres of the items a user scored above ``threshold``.
    Rows ``uid, genre``."""
    liked = ratings.where(F.col("score") > threshold).select("uid", "mid")
    g = items.select("mid", F.explode(split_genres(F.col("genres"))).alias("genre")).where(F.col("genre") != "")
    return liked.join(g, "mid").select("uid", "genre").distinct()


def declared_pref_genres(tags: DataFrame, items: DataFrame, event: str = "signup") -> DataFrame:
    """Declared preferences (Q14 change table): at sign-up a user names an
    item; its genres are the user's declared genres. Rows ``uid, genre``."""
    picks = tags.where(F.col("tag") == event).select("uid", "mid")
    g = items.select("mid", F.explode(split_genres(F.col("genres"))).alias("genre")).where(F.col("genre") != "")
    return picks.join(g, "mid").select("uid", "genre").distinct()


def merge_prefs(derived: DataFrame, declared: DataFrame) -> DataFrame:
    """Q14/U4: union-distinct of derived and declared genres per user, one row
    per (uid, genre); the array form is ``array_union`` of the two sets."""
    return derived.unionByName(declared).distinct()


def genre_browse(items: DataFrame, profile: DataFrame, n: int = BROWSE_SIZE, sort_by: str = "rating") -> DataFrame:
    """Items of each genre (exact genre token, every item kept) sorted by
    mean rating or release year, first n. Rows ``genre, rank, mid, value``."""
    key = {"rating": "avg_rating", "releaseYear": "release_year"}[sort_by]
    g = items.select("mid", F.explode(split_genres(F.col("genres"))).alias("genre")).where(F.col("genre") != "")
    j = g.distinct().join(profile.select("mid", F.col(key).cast("double").alias("value")), "mid")
    return top_k_per_group(j, ["genre"], [F.col("value").desc(), F.col("mid").asc()], n)


def cold_start(prefs: DataFrame, genre_top: DataFrame, n: int = COLD_START_SIZE) -> DataFrame:
    """Union of the genre top lists over a user's preferred genres,
    duplicates removed, best mean score first (ties: item id), first n.

    ``genre_top`` has at most 10 rows per genre, so the join emits at most
    10 x (preferred genres) rows per user; the top-n is partial per task.
    """
    cand = prefs.join(genre_top.select("genre", "mid", "avg"), "genre")
    best = cand.groupBy("uid", "mid").agg(F.max("avg").alias("score"))
    return top_k_per_group(best, ["uid"], [F.col("score").desc(), F.col("mid").asc()], n)


def recs_with_fallback(primary: DataFrame, fallback: DataFrame, users: DataFrame) -> DataFrame:
    """Q8: the primary list where a user has one, else the fallback list.
    Inputs are ``uid, rank, mid, score``."""
    have = primary.select("uid").distinct()
    rest = fallback.join(have, "uid", "left_anti").join(users.select("uid"), "uid", "left_semi")
    return primary.unionByName(rest)


def stream_fallback(stream_recs: DataFrame, most_rated: DataFrame, ratings: DataFrame, users: DataFrame,
                    size: int = STREAM_LIST_SIZE, head: int = POPULAR_HEAD) -> DataFrame:
    """Q6: the user's streaming list, or the most-rated items when the user has
    none; items the user rated removed; best first, first ``size``.

    Fallback without a users x items table: with popularity positions 1..N
    (distributed global order) and the user's rated popular items at sorted
    positions q_1 < q_2 < ..., the j-th unrated position is
    ``j + #{k : q_k - k < j}``. The counts for j = 1..size are one grouped
    aggregate per user (partial, skew-safe); the positions join back to the
    popularity table on equality.
    """
    own = stream_recs.select("uid", "mid", "score").join(ratings.select("uid", "mid"), ["uid", "mid"], "left_anti")
    own = top_k_per_group(own, ["uid"], [F.round("score", 9).desc(), F.col("mid").asc()], size)

    need = users.select("uid").join(stream_recs.select("uid").distinct(), "uid", "left_anti")
    pop = global_row_number(most_rated.select("mid", "count"), [F.col("count").desc(), F.col("mid").asc()], "_q")
    pop = pop.withColumn("_q", F.col("_q") + 1)
    rated = ratings.select("uid", "mid").join(need, "uid", "left_semi").join(pop.select("mid", "_q"), "mid")
    rated = key_positions(rated, "uid", ["_q"], "_k").withColumn("_gap", F.col("_q") - (F.col("_k") + 1))
    skip = rated.groupBy("uid").agg(*[F.count_if(F.col("_gap") < j).alias(f"_s{j}") for j in range(1, size + 1)])
    slots = need.join(skip, "uid", "left").select(
        "uid", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.coalesce(F.col(f"_s{j}"), F.lit(0)).alias("s"))
                                   for j in range(1, size + 1)])).alias("_t"))
    slots = slots.select("uid", F.col("_t.j").cast("bigint").alias("rank"), (F.col("_t.j") + F.col("_t.s")).alias("_q"))
    # Nearly all users want the same few first positions: those are one small array looked up in place,
    # so that only users who rated far down the list meet the popularity table in a join.
    first = pop.where(F.col("_q") <= head).agg(F.array_sort(F.collect_list(F.struct("_q", "mid", "count")))).scalar()
    near = (slots.where(F.col("_q") <= head).select("uid", "rank", F.get(first, (F.col("_q") - 1).cast("int")).alias("_m"))
            .where(F.col("_m").isNotNull()).select("uid", "rank", F.col("_m.mid").alias("mid"), F.col("_m.count").alias("count")))
    far = slots.where(F.col("_q") > head).join(pop, "_q").select("uid", "rank", "mid", "count")
    fb = near.unionByName(far).select("uid", "rank", "mid", F.col("count").cast("double").alias("score"))
    return own.unionByName(fb)


def sort_lists(lists: DataFrame, profile: DataFrame, sort_by: str) -> DataFrame:
    """Q6 sort option: each user's list by mean rating or release year, best or
    newest first; equal values keep their order. ``value`` is what it sorts by."""
    key = {"rating": "avg_rating", "releaseYear": "release_year"}[sort_by]
    j = lists.join(profile.select("mid", F.col(key).cast("double").alias("value")), "mid")
    order = Window.partitionBy("uid").orderBy(F.col("value").desc(), F.col("rank").asc())
    return j.withColumn("rank", F.row_number().over(order).cast("bigint")).select("uid", "rank", "mid", "value")
