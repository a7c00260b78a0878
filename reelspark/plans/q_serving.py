"""Serving queries (profiles, browse, cold start, fallbacks, incremental users)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelspark.functions.columns import rounded
from reelspark.operators import als, indexing, serving, similarity as sim, stats
from reelspark.plans.q_similarity import CONTENT_SIM_SQL, CONTENT_THRESHOLD, TFIDF_SQL
from reelspark.plans.catalog import query
from reelspark.plans.q_models import RULE_CTES, RULE_LISTS_SQL, als_model, rule_factors
from reelspark.plans.oracle import with_views
from reelspark.session import checkpoint_dir
from reelspark.sources import driver_tables as src
from reelspark.sources import sinks

ITEM_PROFILE_SQL = """
select i.mid, trim(regexp_replace(i.title, '\\s*\\(\\d{4}\\)\\s*$', '')) title, i.genres,
  coalesce(try_cast(nullif(regexp_extract(i.title, '\\((\\d{4})\\)\\s*$', 1), '') as integer), -1) release_year,
  coalesce(a.n, 0) rating_count, coalesce(a.avg, 0.0) avg_rating
from items i left join (select mid, count(*) n, avg(score) avg from ratings group by mid) a on i.mid = a.mid"""


@query("item_profile", "Q11 A18 (catalogue row + rating count and mean)", with_views(
    "select mid, title, genres, release_year, rating_count, round(avg_rating, 6) avg_rating from ip",
    "ratings", "items", extra={"ip": ITEM_PROFILE_SQL}))
def item_profile(spark, d):
    p = serving.item_profile(src.items(spark, d), src.ratings(spark, d))
    return p.withColumn("avg_rating", rounded(F.col("avg_rating")))


@query("item_top_ratings", "T11 (10 best ratings per item, earlier first on ties)", with_views("""
select mid, rank, uid, score, ts from (
  select mid, uid, score, ts,
         cast(row_number() over (partition by mid order by score desc, ts, uid) as bigint) rank
  from ratings) t where rank <= 10""", "ratings"))
def item_top_ratings(spark, d):
    return serving.item_top_ratings(src.ratings(spark, d))


@query("user_profile", "Q12 A17 (count, mean, highest, true lowest)", with_views("""
select u.uid, u.username, coalesce(a.n, 0) rating_count, round(coalesce(a.avg, 0.0), 6) avg_rating,
       coalesce(a.hi, 0.0) highest_rating, coalesce(a.lo, 0.0) lowest_rating
from users u left join (select uid, count(*) n, avg(score) avg, max(score) hi, min(score) lo
                        from ratings group by uid) a on u.uid = a.uid""", "ratings", "users"))
def user_profile(spark, d):
    p = serving.user_profile(src.users(spark, d), src.ratings(spark, d))
    return p.withColumn("avg_rating", rounded(F.col("avg_rating")))


HISTORY_SEGMENT = 25


@query("user_history", "Q12 S17 (every rating of a user, as JSON segments in order of time)", with_views(f"""
with placed as (select *, (row_number() over (partition by uid order by ts, mid) - 1) // {HISTORY_SEGMENT} segment from ratings)
select uid, cast(segment as bigint) segment, count(*) n, min(ts) first_ts, max(ts) last_ts,
  cast(to_json(list({{'rating': {{'mid': mid, 'score': score, 'timestamp': ts}}}} order by ts, mid)) as varchar) ratings
from placed group by uid, segment""", "ratings"))
def user_history(spark, d):
    return serving.user_history(src.ratings(spark, d), HISTORY_SEGMENT)


INDEX_BUCKETS = 8


def indexed_items(spark, d):
    """The catalogue as a bucketed table with bloom filters, below the shared folder."""
    name = f"items_{uuid.uuid4().hex}"
    sinks.write_bucketed(src.items(spark, d), name, "mid", INDEX_BUCKETS, f"{checkpoint_dir(spark).rstrip('/')}/{name}")
    return spark.table(name)


@query("lookup_items", "S8 P11 (rows of the tagged items, looked up by key in a bucketed index)", with_views("""
select i.mid, i.title, i.genres from items i where i.mid in (select mid from tags)""", "items", "tags"))
def lookup_items(spark, d):
    return serving.lookup_many(src.tags(spark, d), indexed_items(spark, d), "mid")


@query("user_pref_genres", "A19 P4 J20 (genres of items scored > 3)", with_views(
    "select uid, genre from user_pref", "user_pref"))
def user_pref_genres(spark, d):
    return serving.derived_pref_genres(src.ratings(spark, d), src.items(spark, d))


DECLARED_SQL = """
select distinct t.uid, g genre from tags t join items i on t.mid = i.mid,
  unnest(string_split(i.genres, '|')) s(g) where t.tag = 'signup' and g <> ''"""


@query("pref_merge", "Q14 U4 (declared at sign-up union derived genres)", with_views(
    "select uid, genre from user_pref union select uid, genre from declared", "user_pref", "tags",
    extra={"declared": DECLARED_SQL}))
def pref_merge(spark, d):
    it = src.items(spark, d)
    return serving.merge_prefs(serving.derived_pref_genres(src.ratings(spark, d), it),
                               serving.declared_pref_genres(src.tags(spark, d), it))


@query("genre_browse", "Q1 T9 T10 (16 best-rated items per genre)", with_views("""
select genre, rank, mid, round(value, 6) value from (
  select g.genre, g.mid, ip.avg_rating value,
         cast(row_number() over (partition by g.genre order by ip.avg_rating desc, g.mid) as bigint) rank
  from (select distinct mid, s.g genre from items, unnest(string_split(genres, '|')) s(g) where s.g <> '') g
  join ip on g.mid = ip.mid) t where rank <= 16""", "ratings", "items", extra={"ip": ITEM_PROFILE_SQL}))
def genre_browse(spark, d):
    it = src.items(spark, d)
    b = serving.genre_browse(it, serving.item_profile(it, src.ratings(spark, d)))
    return b.select("genre", "rank", "mid", rounded(F.col("value")).alias("value"))


@query("genre_browse_year", "Q1 T9 (16 newest items per genre)", with_views("""
select genre, rank, mid, value from (
  select g.genre, g.mid, cast(ip.release_year as double) value,
         cast(row_number() over (partition by g.genre order by ip.release_year desc, g.mid) as bigint) rank
  from (select distinct mid, s.g genre from items, unnest(string_split(genres, '|')) s(g) where s.g <> '') g
  join ip on g.mid = ip.mid) t where rank <= 16""", "ratings", "items", extra={"ip": ITEM_PROFILE_SQL}))
def genre_browse_year(spark, d):
    it = src.items(spark, d)
    return serving.genre_browse(it, serving.item_profile(it, src.ratings(spark, d)), sort_by="releaseYear")


@query("cold_start_recs", "Q7 U2 (union of preferred genres' top lists)", with_views("""
select uid, rank, mid, round(score, 6) score from (
  select uid, mid, score, cast(row_number() over (partition by uid order by score desc, mid) as bigint) rank
  from (select p.uid, t.mid, max(t.avg) score from prefs p join genre_top t on p.genre = t.genre
        group by p.uid, t.mid) x) y where rank <= 10""", "user_pref", "tags", "genre_top",
    extra={"declared": DECLARED_SQL,
           "prefs": "select uid, genre from user_pref union select uid, genre from declared"}))
def cold_start_recs(spark, d):
    return _cold_lists(spark, d).withColumn("score", rounded(F.col("score")))


def _cold_lists(spark, d):
    r, it = src.ratings(spark, d), src.items(spark, d)
    prefs = serving.merge_prefs(serving.derived_pref_genres(r, it),
                                serving.declared_pref_genres(src.tags(spark, d), it))
    return serving.cold_start(prefs, stats.genre_top_n(it, stats.avg_score(r)))


@query("user_recs_fallback", "Q8 (ALS list, else cold start)")
def user_recs_fallback(spark, d):
    lists = als.user_recs(als_model(spark, d))
    return serving.recs_with_fallback(lists, _cold_lists(spark, d), src.users(spark, d)).withColumn("score", rounded(F.col("score")))


@query("factor_recs_fallback", "Q8 (lists from fixed factors that lack some users, else cold start)", with_views(f"""
with lists as ({RULE_LISTS_SQL.replace("where not exists (select 1 from ratings r where r.uid = u.uid and r.mid = i.mid)", "")}),
cold as (select uid, rank, mid, score from (
  select uid, mid, score, cast(row_number() over (partition by uid order by score desc, mid) as bigint) rank
  from (select p.uid, t.mid, max(t.avg) score from prefs p join genre_top t on p.genre = t.genre group by p.uid, t.mid) x) y where rank <= 10)
select uid, rank, mid, round(score, 6) score from lists
union all
select uid, rank, mid, round(score, 6) score from cold where uid in (select uid from users) and uid not in (select uid from lists)""",
    "ratings", "users", "items", "user_pref", "tags", "genre_top",
    extra={**RULE_CTES, "declared": DECLARED_SQL, "prefs": "select uid, genre from user_pref union select uid, genre from declared"}))
def factor_recs_fallback(spark, d):
    lists = als.user_recs(rule_factors(spark, d))
    return serving.recs_with_fallback(lists, _cold_lists(spark, d), src.users(spark, d)).withColumn("score", rounded(F.col("score")))


# Incremental user index: the index as of a cut date, then later sign-ups.
INDEX_CUT_TS = 820454400   # 1996-01-01 00:00:00 UTC


@query("new_user_index", "A21 Q15 (users first seen after the cut get max+1, max+2, ...)", with_views(f"""
with firsts as (select uid, min(ts) t0 from ratings group by uid),
old as (select uid, cast(row_number() over (order by uid) - 1 as bigint) user_idx from firsts where t0 < {INDEX_CUT_TS}),
fresh as (select uid from firsts where t0 >= {INDEX_CUT_TS})
select uid, cast((select coalesce(max(user_idx), -1) from old) + row_number() over (order by uid) as bigint) user_idx
from fresh""", "ratings"))
def new_user_index(spark, d):
    r = src.ratings(spark, d)
    firsts = r.groupBy("uid").agg(F.min("ts").alias("t0"))
    old = indexing.dense_index(firsts.where(F.col("t0") < INDEX_CUT_TS), "uid", "user_idx")
    return indexing.next_user_index(old, firsts.where(F.col("t0") >= INDEX_CUT_TS), "uid", "user_idx")


@query("similar_items_topn", "Q10 J21 T10 (10 most similar items by content, with their titles)", with_views("""
with tw as (TFIDF), cs as (CONTENT)
select mid, rank, sim_mid, round(score, 6) score, title from (
  select cs.mid, cs.sim_mid, cs.score, i.title,
         cast(row_number() over (partition by cs.mid order by round(cs.score, 9) desc, cs.sim_mid) as bigint) rank
  from cs left join items i on i.mid = cs.sim_mid) t where rank <= 10"""
    .replace("TFIDF", TFIDF_SQL.strip()).replace("CONTENT", CONTENT_SIM_SQL.strip()
                                                  .replace("round(sum(a.w * b.w), 6)", "sum(a.w * b.w)")), "items"))
def similar_items_topn(spark, d):
    it = src.items(spark, d)
    t = sim.tfidf(sim.genre_terms(it))
    top = sim.sparse_cosine_groups(t.select("mid", "term", "w"), CONTENT_THRESHOLD).top_k(10)
    out = serving.hydrate(top, it.select("mid", "title"), "sim_mid", "mid")
    return out.select("mid", "rank", "sim_mid", rounded(F.col("score")).alias("score"), "title")


@query("similar_users_named", "Q9 J22 (10 most similar users by ALS factors, with user names)")
def similar_users_named(spark, d):
    top = als.similar_users(als_model(spark, d))
    out = serving.hydrate(top, src.users(spark, d), "sim_uid", "uid")
    return out.select("uid", "rank", "sim_uid", rounded(F.col("score")).alias("score"), "username")


@query("stat_sql_views", "S19 A1 A3 (temp views + SQL text, as the statistics job)", with_views("""
select m.mid, m.count, round(a.avg, 6) avg from (select mid, count(mid) as count from ratings group by mid) m
join (select mid, avg(score) avg from ratings group by mid) a on m.mid = a.mid""", "ratings"))
def stat_sql_views(spark, d):
    """Registers the ratings view and runs the statistics as SQL text; Catalyst
    plans it exactly like the DataFrame form."""
    src.ratings(spark, d).createOrReplaceTempView("reelspark_ratings")
    return spark.sql("""
        select m.mid, m.count, round(a.avg, 6) as avg
        from (select mid, count(mid) as count from reelspark_ratings group by mid) m
        join (select mid, avg(score) as avg from reelspark_ratings group by mid) a on m.mid = a.mid""")
