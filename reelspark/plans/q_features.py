"""Feature-engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions.columns import rounded
from reelspark.operators import features as fe
from reelspark.plans.catalog import query
from reelspark.plans.oracle import with_views
from reelspark.sources import driver_tables as src

ITEM_FEATURES_SQL = """
select mid, count(*) rating_count, avg(score) avg_rating, var_samp(score) rating_var
from ratings group by mid"""


@query("item_features", "A5", with_views(
    "select mid, rating_count, round(avg_rating, 6) avg_rating, round(rating_var, 6) rating_var from f",
    "ratings", extra={"f": ITEM_FEATURES_SQL}))
def item_features(spark, d):
    f = fe.item_rating_features(src.ratings(spark, d))
    return f.select("mid", "rating_count", rounded(F.col("avg_rating")).alias("avg_rating"),
                    rounded(F.col("rating_var")).alias("rating_var"))


@query("item_features_scaled", "F6 (min-max of the mean score)", with_views("""
select mid, round(case when (select max(avg_rating) from f) = (select min(avg_rating) from f) then 0.5
  else (avg_rating - (select min(avg_rating) from f)) /
       ((select max(avg_rating) from f) - (select min(avg_rating) from f)) end, 6) avg_scaled
from f""", "ratings", extra={"f": ITEM_FEATURES_SQL}))
def item_features_scaled(spark, d):
    f = fe.min_max_scaled(fe.item_rating_features(src.ratings(spark, d)), "avg_rating", "avg_scaled")
    return f.select("mid", rounded(F.col("avg_scaled")).alias("avg_scaled"))


@query("item_buckets", "F5 (exact ntile(100) of the rating count)", with_views("""
select mid, rating_count, ntile(100) over (order by rating_count, mid) count_bucket from f""",
    "ratings", extra={"f": ITEM_FEATURES_SQL}))
def item_buckets(spark, d):
    f = fe.item_rating_features(src.ratings(spark, d)).select("mid", "rating_count")
    return fe.exact_quantile_buckets(f, ["rating_count", "mid"], 100, "count_bucket")


@query("item_ml_features", "F7 F5 F6 (Spark ML stages: QuantileDiscretizer + MinMaxScaler; rows only)")
def item_ml_features(spark, d):
    f = fe.item_rating_features(src.ratings(spark, d))
    out = fe.ml_item_stages(f)
    return out.select("mid", "rating_count", F.col("count_bucket").cast("bigint").alias("count_bucket"),
                      rounded(F.col("avg_scaled")).alias("avg_scaled"))


@query("onehot_item", "F2", with_views(
    "select mid, cast((select max(mid) + 1 from items) as bigint) vec_size, cast(mid as bigint) hot_index from items",
    "items"))
def onehot_item(spark, d):
    return fe.one_hot_ids(src.items(spark, d), "mid")


GENRE_INDEX_SQL = """
select genre, cast(row_number() over (order by freq desc, genre) - 1 as bigint) genre_idx, freq from (
  select g genre, count(*) freq from items, unnest(string_split(genres, '|')) t(g) group by g) x"""


@query("genre_index", "F3", with_views("select genre, freq, genre_idx from gi", "items",
                                        extra={"gi": GENRE_INDEX_SQL}))
def genre_index(spark, d):
    return fe.genre_frequency_index(src.items(spark, d)).select("genre", "freq", "genre_idx")


@query("multihot_genres", "F4 A9", with_views("""
select distinct i.mid, gi.genre_idx from items i, unnest(string_split(i.genres, '|')) t(g)
join gi on gi.genre = t.g""", "items", extra={"gi": GENRE_INDEX_SQL}))
def multihot_genres(spark, d):
    it = src.items(spark, d)
    return fe.multi_hot_genres(it, fe.genre_frequency_index(it))


SAMPLE_ITEM_SQL = """
select r.uid, r.mid, r.score, r.ts, case when r.score >= 3.5 then 1 else 0 end label, i.genres,
  coalesce(try_cast(nullif(regexp_extract(i.title, '\\((\\d{4})\\)\\s*$', 1), '') as integer), 1990) release_year,
  trim(regexp_replace(i.title, '\\s*\\(\\d{4}\\)\\s*$', '')) title,
  string_split(i.genres, '|')[1] movie_genre1, string_split(i.genres, '|')[2] movie_genre2,
  string_split(i.genres, '|')[3] movie_genre3
from ratings r left join items i on r.mid = i.mid"""


@query("sample_item_features", "F8 J11 J12 A6 P17 P14", with_views("""
select s.uid, s.mid, s.score, s.ts, s.label, s.release_year, s.title, s.movie_genre1, s.movie_genre2,
       s.movie_genre3, m.movie_rating_count, round(m.movie_avg_rating, 6) movie_avg_rating,
       round(m.movie_rating_stddev, 6) movie_rating_stddev
from s left join (select mid, count(*) movie_rating_count, avg(score) movie_avg_rating,
                         stddev_samp(score) movie_rating_stddev from s group by mid) m on s.mid = m.mid""",
    "ratings", "items", extra={"s": SAMPLE_ITEM_SQL}))
def sample_item_features(spark, d):
    f = fe.sample_item_features(src.ratings(spark, d), src.items(spark, d))
    return f.select("uid", "mid", "score", "ts", "label", "release_year", "title", "movie_genre1",
                    "movie_genre2", "movie_genre3", "movie_rating_count",
                    rounded(F.col("movie_avg_rating")).alias("movie_avg_rating"),
                    rounded(F.col("movie_rating_stddev")).alias("movie_rating_stddev"))


USER_FEATURES_SQL = """
with p as (
  select *, row_number() over (partition by uid order by ts, mid) pos from s),
h as (
  select c.uid, c.mid, c.pos, h.mid hmid, h.label hlabel, h.genres hgenres, h.score hscore,
         h.release_year hyear, h.pos hpos
  from p c left join p h on h.uid = c.uid and h.pos between c.pos - 100 and c.pos - 1),
agg as (
  select uid, mid, count(hpos) user_rating_count, avg(hyear) user_avg_release_year,
         stddev_samp(hyear) user_release_year_stddev, avg(hscore) user_avg_rating,
         stddev_samp(hscore) user_rating_stddev,
         list(hmid order by hpos desc) filter (where hlabel = 1) hist
  from h group by uid, mid),
gc as (
  select uid, mid, g genre, count(*) n from h, unnest(string_split(hgenres, '|')) t(g)
  where hlabel = 1 group by uid, mid, g),
gr as (
  select uid, mid, genre, row_number() over (partition by uid, mid order by n desc, genre) rk from gc),
gp as (
  select uid, mid, max(case when rk = 1 then genre end) user_genre1, max(case when rk = 2 then genre end) user_genre2,
         max(case when rk = 3 then genre end) user_genre3, max(case when rk = 4 then genre end) user_genre4,
         max(case when rk = 5 then genre end) user_genre5 from gr group by uid, mid)
select p.uid, p.mid, p.ts, p.label,
  a.hist[1] user_rated_movie1, a.hist[2] user_rated_movie2, a.hist[3] user_rated_movie3,
  a.hist[4] user_rated_movie4, a.hist[5] user_rated_movie5,
  a.user_rating_count, round(a.user_avg_release_year, 6) user_avg_release_year,
  round(a.user_release_year_stddev, 6) user_release_year_stddev,
  round(a.user_avg_rating, 6) user_avg_rating, round(a.user_rating_stddev, 6) user_rating_stddev,
  gp.user_genre1, gp.user_genre2, gp.user_genre3, gp.user_genre4, gp.user_genre5
from p join agg a on p.uid = a.uid and p.mid = a.mid
left join gp on p.uid = gp.uid and p.mid = gp.mid"""

USER_FEATURE_COLS = (["uid", "mid", "ts", "label"] + [f"user_rated_movie{i}" for i in range(1, 6)]
                     + ["user_rating_count", "user_avg_release_year", "user_release_year_stddev",
                        "user_avg_rating", "user_rating_stddev"]
                     + [f"user_genre{i}" for i in range(1, 6)])


def user_feature_frame(spark, d, chunk_rows=None):
    s = fe.sample_item_features(src.ratings(spark, d), src.items(spark, d))
    s = s.select("uid", "mid", "score", "ts", "label", "genres", "release_year")
    kw = {} if chunk_rows is None else {"chunk_rows": chunk_rows}
    f = fe.sample_user_features(s, **kw)
    dbl = {"user_avg_release_year", "user_release_year_stddev", "user_avg_rating", "user_rating_stddev"}
    return f.select(*[rounded(F.col(c)).alias(c) if c in dbl else F.col(c) for c in USER_FEATURE_COLS])


@query("sample_user_features", "F8 W1-W7 A25 P18 (100 preceding ratings)",
       with_views(USER_FEATURES_SQL, "ratings", "items", extra={"s": SAMPLE_ITEM_SQL}))
def sample_user_features(spark, d):
    return user_feature_frame(spark, d)
