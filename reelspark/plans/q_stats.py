"""Ingest, indexing, labels and popularity statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions.columns import (INCLUSIVE_LIKE_THRESHOLD, STRICT_LIKE_THRESHOLD, like_label,
                                         rounded)
from reelspark.operators import indexing, stats
from reelspark.plans.catalog import query
from reelspark.plans.oracle import with_views
from reelspark.sources import driver_tables as src


@query("stat_most_rated", "A1 T1 S19", with_views(
    "select mid, count(mid) as count from ratings group by mid", "ratings"))
def stat_most_rated(spark, d):
    return stats.most_rated(src.ratings(spark, d))


@query("stat_recent_rated", "A2 T1", with_views("""
select cast(year(make_timestamp(ts * 1000000)) * 100 + month(make_timestamp(ts * 1000000)) as integer) yearmonth,
       mid, count(mid) as count
from ratings group by 1, 2""", "ratings"))
def stat_recent_rated(spark, d):
    return stats.recent_rated(src.ratings(spark, d))


@query("stat_avg_score", "A3 T1", with_views(
    "select mid, round(avg(score), 6) as avg from ratings group by mid", "ratings"))
def stat_avg_score(spark, d):
    return stats.avg_score(src.ratings(spark, d)).withColumn("avg", rounded(F.col("avg")))


@query("top_most_rated", "T8 Q2", with_views("""
select cast(row_number() over (order by count desc, mid) as bigint) rank, mid, count from (
  select mid, count(mid) as count from ratings group by mid) t
order by count desc, mid limit 10""", "ratings"))
def top_most_rated(spark, d):
    return stats.top_report(stats.most_rated(src.ratings(spark, d)), "count")


@query("top_avg_score", "T8 Q3", with_views("""
select cast(row_number() over (order by avg desc, mid) as bigint) rank, mid, round(avg, 6) avg
from avg_scores order by avg desc, mid limit 10""", "avg_scores"))
def top_avg_score(spark, d):
    t = stats.top_report(stats.avg_score(src.ratings(spark, d)), "avg")
    return t.withColumn("avg", rounded(F.col("avg")))


@query("top_recent_rated", "T8 Q5 (yearmonth desc, count desc, mid)", with_views("""
select cast(row_number() over (order by yearmonth desc, count desc, mid) as bigint) rank, yearmonth, mid, count
from (select cast(year(make_timestamp(ts * 1000000)) * 100 + month(make_timestamp(ts * 1000000)) as integer) yearmonth,
             mid, count(mid) as count from ratings group by 1, 2) t
order by yearmonth desc, count desc, mid limit 10""", "ratings"))
def top_recent_rated(spark, d):
    return stats.top_report(stats.recent_rated(src.ratings(spark, d)), "count", by_month=True)


@query("stat_genre_topn", "J4 J6 P7 T2 Q4", with_views(
    "select genre, rank, mid, round(avg, 6) avg from genre_top", "genre_top"))
def stat_genre_topn(spark, d):
    it = src.items(spark, d)
    t = stats.genre_top_n(it, stats.avg_score(src.ratings(spark, d)))
    return t.select("genre", "rank", "mid", rounded(F.col("avg")).alias("avg"))


GENRE_PICK_SQL = """
with recursive gl as (select genre, row_number() over (order by genre) gi from (select distinct genre from genre_top) x),
walk(gi, picked, genre, mid, avg) as (
  select 0::bigint, []::bigint[], null::varchar, null::bigint, null::double
  union all
  select g.gi, case when p.mid is null then w.picked else list_append(w.picked, p.mid) end, g.genre, p.mid, p.avg
  from walk w join gl g on g.gi = w.gi + 1
  left join lateral (select t.mid, t.avg from genre_top t
                     where t.genre = g.genre and not list_contains(w.picked, t.mid)
                     order by t.rank limit 1) p on true)
select genre, mid, round(avg, 6) avg from walk where mid is not null"""


@query("stat_genre_pick", "U3 Q4 (greedy: per genre in name order, best item not yet picked)",
       with_views(GENRE_PICK_SQL, "genre_top"))
def stat_genre_pick(spark, d):
    it = src.items(spark, d)
    t = stats.genre_top_n(it, stats.avg_score(src.ratings(spark, d)))
    return stats.genre_pick(t).withColumn("avg", rounded(F.col("avg")))


@query("rating_histogram", "A7 A23 T13", with_views("""
select score, count(*) as count, round(count(*) / (select count(*) from ratings), 6) percentage
from ratings group by score""", "ratings"))
def rating_histogram(spark, d):
    return stats.rating_histogram(src.ratings(spark, d))


@query("latest_ratings", "S16 A12 (rating upsert: newest version per (uid, mid))",
       with_views("select uid, mid, score, ts from ratings", "ratings"))
def latest_ratings(spark, d):
    return src.ratings(spark, d)


@query("label_strict", "P1 S9 (score > 3.5)", with_views(
    "select uid, mid, score, ts, case when score > 3.5 then 1 else 0 end as label from ratings", "ratings"))
def label_strict(spark, d):
    r = src.ratings(spark, d)
    return r.withColumn("label", like_label(F.col("score"), STRICT_LIKE_THRESHOLD, strict=True))


@query("label_inclusive", "P2 (rating >= 3.5)", with_views(
    "select uid, mid, score, ts, case when score >= 3.5 then 1 else 0 end as label from ratings", "ratings"))
def label_inclusive(spark, d):
    r = src.ratings(spark, d)
    return r.withColumn("label", like_label(F.col("score"), INCLUSIVE_LIKE_THRESHOLD, strict=False))


@query("index_users", "F1 A12 (dense user index in key order)", with_views(
    "select uid, cast(row_number() over (order by uid) - 1 as bigint) user_idx from (select distinct uid from ratings) t",
    "ratings"))
def index_users(spark, d):
    return indexing.dense_index(src.ratings(spark, d), "uid", "user_idx")


@query("index_items", "F1 A12 J1 J23 (dense item index in key order)", with_views(
    "select mid, cast(row_number() over (order by mid) - 1 as bigint) item_idx from (select distinct mid from items) t",
    "items"))
def index_items(spark, d):
    return indexing.dense_index(src.items(spark, d), "mid", "item_idx")


@query("indexed_ratings", "J2 J3 S9 (training samples: indexes + strict label)", with_views("""
select r.uid, r.mid, u.user_idx, i.item_idx, case when r.score > 3.5 then 1 else 0 end as label
from ratings r
left join (select uid, cast(row_number() over (order by uid) - 1 as bigint) user_idx
           from (select distinct uid from ratings) t) u on r.uid = u.uid
left join (select mid, cast(row_number() over (order by mid) - 1 as bigint) item_idx
           from (select distinct mid from items) t) i on r.mid = i.mid""", "ratings", "items"))
def indexed_ratings(spark, d):
    r = src.ratings(spark, d)
    uidx = indexing.dense_index(r, "uid", "user_idx")
    iidx = indexing.dense_index(src.items(spark, d), "mid", "item_idx")
    out = indexing.attach_index(indexing.attach_index(r, uidx, "uid"), iidx, "mid")
    return out.select("uid", "mid", "user_idx", "item_idx",
                      like_label(F.col("score"), STRICT_LIKE_THRESHOLD, strict=True).alias("label"))
