"""Log, message, JSON and streaming re-rank queries.

The rating stream is the application log derived from ``events``: purchase
and view lines carry ``MOVIE_RATING_PREFIX:uid|mid|score|ts``. The similarity
table feeding the re-ranker is the content similarity (TF-IDF cosine > 0.6).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions.columns import rounded
from reelspark.operators import serving, similarity as sim, stats
from reelspark.operators.upsert import last_write_wins
from reelspark.plans.catalog import query
from reelspark.plans.oracle import with_views
from reelspark.session import checkpoint_dir, shuffle_partitions
from reelspark.plans.q_similarity import CONTENT_SIM_SQL, CONTENT_THRESHOLD, TFIDF_SQL
from reelspark.sources import driver_tables as src
from reelspark.sources import movielens
from reelspark.streaming import job, topic
from reelspark.streaming import rerank as rr

MSG_SQL = """
select event_id, trim(split_part(line, 'MOVIE_RATING_PREFIX:', 2)) message
from log_lines where contains(line, 'MOVIE_RATING_PREFIX:')"""

EVENTS_SQL = """
select event_id, uid, mid, score, ts from (
  select event_id, try_cast(trim(p[1]) as bigint) uid, try_cast(trim(p[2]) as bigint) mid,
         try_cast(trim(p[3]) as double) score, try_cast(trim(p[4]) as bigint) ts, len(p) nf
  from (select event_id, string_split(message, '|') p from msgs) a) b
where nf = 4 and uid is not null and mid is not null and score is not null and ts is not null"""

RECENT_SQL = """
select uid, mid, score, cast(row_number() over (partition by uid order by ts desc, mid desc, score desc) as bigint) rank
from ev"""

CANDS_SQL = """
select uid, mid, sim, rank from (
  select l.uid, s.sim_mid mid, s.score sim,
         cast(row_number() over (partition by l.uid order by round(s.score, 9) desc, s.sim_mid) as bigint) rank
  from (select uid, mid from rec where rank = 1) l
  join sims s on s.mid = l.mid
  where not exists (select 1 from ev e where e.uid = l.uid and e.mid = s.sim_mid)) t where rank <= 10"""

SCORES_SQL = """
select uid, mid, score, cast(row_number() over (partition by uid order by round(score, 9) desc, mid) as bigint) rank from (
  select c.uid, c.mid,
         avg(coalesce(s.score, 0.0) * r.score)
           + log10(greatest(count_if(r.score > 3.0), 1)) - log10(greatest(count_if(r.score <= 3.0), 1)) score
  from cands c join (select * from rec where rank <= 20) r on c.uid = r.uid
  left join sims s on s.mid = c.mid and s.sim_mid = r.mid
  where coalesce(s.score, 0.0) > 0.7
  group by c.uid, c.mid) t"""

STREAM_CTES = {"tw": TFIDF_SQL, "sims": CONTENT_SIM_SQL.replace("round(sum(a.w * b.w), 6)", "sum(a.w * b.w)"),
               "msgs": MSG_SQL, "ev": EVENTS_SQL, "rec": RECENT_SQL, "cands": CANDS_SQL, "scores": SCORES_SQL}


def _events(spark, d):
    return rr.parse_messages(rr.filter_log(src.log_lines(spark, d)))


def _sims(spark, d):
    """Content similarity in factorised form (the expanded table is quadratic in
    the size of groups of equal items; the re-ranker never expands it whole)."""
    t = sim.tfidf(sim.genre_terms(src.items(spark, d)))
    return sim.sparse_cosine_groups(t.select("mid", "term", "w"), CONTENT_THRESHOLD)


@query("log_filter", "S12 S13 ST2 P12 (lines with the rating prefix -> message)",
       with_views("select event_id, message from msgs", "log_lines", extra={"msgs": MSG_SQL}))
def log_filter(spark, d):
    return rr.filter_log(src.log_lines(spark, d)).select("event_id", "message")


@query("log_filter_stream", "S11 S12 (stream job: log lines in, rating messages out)", with_views(
    "select message from msgs", "log_lines", extra={"msgs": MSG_SQL}))
def log_filter_stream(spark, d):
    """The log as a stream of files through the filter into a message table."""
    root = job.scratch_root(spark, "log-filter")
    src.log_lines(spark, d).select(F.col("line").alias("value")).repartition(shuffle_partitions(spark)).write.text(f"{root}/source")
    job.start_log_filter(spark, f"{root}/source", f"{root}/messages", f"{root}/checkpoint", trigger={"availableNow": True}).awaitTermination()
    return spark.read.schema("message string").parquet(f"{root}/messages")


@query("topic_filter", "S11 S12 (topic to topic: keyed log records in, rating messages under the same key out)", with_views("""
select cast(event_id as varchar) as "key", message as value from msgs""", "log_lines", extra={"msgs": MSG_SQL}))
def topic_filter(spark, d):
    """The log as records of one topic, filtered into another by the stream job, read back from there."""
    root = job.scratch_root(spark, "topic-filter")
    lines = src.log_lines(spark, d).select(F.col("event_id").cast("string").alias("key"), F.col("line").alias("value"))
    topic.append(lines.repartition(shuffle_partitions(spark)), f"{root}/log")
    topic.start_topic_filter(spark, f"{root}/log", f"{root}/messages", f"{root}/checkpoint", "earliest", {"availableNow": True}).awaitTermination()
    return spark.read.format("topic").load(f"{root}/messages").select("key", "value")


@query("message_parse", "ST3 P6 P15 (typed rating events, bad rows dropped)",
       with_views("select event_id, uid, mid, score, ts from ev", "log_lines",
                  extra={"msgs": MSG_SQL, "ev": EVENTS_SQL}))
def message_parse(spark, d):
    return _events(spark, d).select("event_id", "uid", "mid", "score", "ts")


@query("rating_log_lines", "S14 (rating -> application log line)", with_views("""
select uid, mid, concat('MOVIE_RATING_PREFIX:', cast(uid as varchar), '|', cast(mid as varchar), '|',
                        cast(score as varchar), '|', cast(ts as varchar)) line from ratings""", "ratings"))
def rating_log_lines(spark, d):
    r = src.ratings(spark, d)
    return r.select("uid", "mid", rr.rating_log_line(F.col("uid"), F.col("mid"), F.col("score"),
                                                     F.col("ts")).alias("line"))


@query("recent_k", "T14 ST5 (20 newest rating events per user)", with_views(
    "select uid, rank, mid, score from rec where rank <= 20", "log_lines",
    extra={"msgs": MSG_SQL, "ev": EVENTS_SQL, "rec": RECENT_SQL}))
def recent_k(spark, d):
    return rr.recent_ratings(_events(spark, d))


@query("rerank_candidates", "ST6 J15 T6 (10 unseen items most similar to the last rated)",
       with_views("select uid, rank, mid, round(sim, 6) sim from cands", "log_lines", "items",
                  extra={k: v for k, v in STREAM_CTES.items() if k != "scores"}))
def rerank_candidates(spark, d):
    ev = _events(spark, d)
    c = rr.candidates(rr.last_events(ev), ev, _sims(spark, d))
    return c.select("uid", "rank", "mid", rounded(F.col("sim")).alias("sim"))


RERANK_ORACLE = with_views("select uid, rank, mid, round(score, 6) score from scores", "log_lines", "items",
                           extra=STREAM_CTES)


@query("rerank_scores", "A22 J14 ST7 P5 P9 (batch replay of the streaming lists)", RERANK_ORACLE)
def rerank_scores(spark, d):
    out = rr.rerank_batch(_events(spark, d), _sims(spark, d))
    return out.select("uid", "rank", "mid", rounded(F.col("score")).alias("score"))


STREAM_BATCHES = 4


@query("stream_rerank", "ST1-ST9 S11 S15 S16 (Structured Streaming run; equals the batch replay)",
       RERANK_ORACLE)
def stream_rerank(spark, d):
    """Runs the streaming job over the log, written as files that come in about
    ``STREAM_BATCHES`` micro-batches in no particular order, and returns the
    final lists."""
    root = job.scratch_root(spark, "stream-rerank")
    g = _sims(spark, d)
    files = max(2 * STREAM_BATCHES, shuffle_partitions(spark))
    src.log_lines(spark, d).select(F.col("line").alias("value")).repartition(files).write.text(f"{root}/source")
    q = job.start(spark, f"{root}/source", f"{root}/out", f"{root}/checkpoint", g,
                  trigger={"availableNow": True}, files_per_trigger=-(-files // STREAM_BATCHES))
    q.awaitTermination()
    lists = job.read_lists(spark, f"{root}/out")
    return lists.select("uid", "rank", "mid", rounded(F.col("score")).alias("score"))


FALLBACK_SQL = """
with rt as (select uid, mid from ev group by uid, mid),
pop as (select mid, count(*) cnt, row_number() over (order by count(*) desc, mid) q from rt group by mid),
own as (select s.uid, s.mid, s.score from scores s
        where not exists (select 1 from rt where rt.uid = s.uid and rt.mid = s.mid)),
need as (select uid from users where uid not in (select uid from scores)),
fb as (select n.uid, p.mid, cast(p.cnt as double) score,
              row_number() over (partition by n.uid order by p.q) r
       from need n cross join pop p
       where not exists (select 1 from rt where rt.uid = n.uid and rt.mid = p.mid)),
lists as (
select uid, cast(row_number() over (partition by uid order by round(score, 9) desc, mid) as bigint) rank, mid,
       round(score, 6) score from own
qualify rank <= 10
union all
select uid, cast(r as bigint) rank, mid, round(score, 6) score from fb where r <= 10)
"""


def _fallback_lists(spark, d):
    """Lists of all users: the streaming list where there is one, else the most rated."""
    # The events, the lists (<= 10 rows per user) and the newest ratings each feed several steps;
    # reliable checkpoints parse the log and compute them once.
    checkpoint_dir(spark)
    ev = _events(spark, d).select("uid", "mid", "score", "ts").checkpoint(eager=True)
    lists = rr.rerank_batch(ev, _sims(spark, d)).checkpoint(eager=True)
    rated = last_write_wins(ev, ["uid", "mid"], list(rr.EVENT_ORDER), ["score"]).checkpoint(eager=True)
    return serving.stream_fallback(lists, stats.most_rated(rated), rated, src.users(spark, d))


@query("stream_recs_fallback", "Q6 (stream list, else most rated; rated removed; first 10; all users)", with_views(
    FALLBACK_SQL + "select uid, rank, mid, score from lists", "log_lines", "items", "users", extra=STREAM_CTES))
def stream_recs_fallback(spark, d):
    return _fallback_lists(spark, d).select("uid", "rank", "mid", rounded(F.col("score")).alias("score"))


@query("stream_recs_sorted", "Q6 sort option (the same lists by release year)", with_views(
    FALLBACK_SQL + """
select uid, mid, value, cast(row_number() over (partition by uid order by value desc, rank) as bigint) rank
from (select l.uid, l.rank, l.mid, cast(coalesce(try_cast(nullif(regexp_extract(i.title, '\\((\\d{4})\\)\\s*$', 1), '') as integer), -1) as double) value
      from lists l join items i on i.mid = l.mid) t""", "log_lines", "items", "users", extra=STREAM_CTES))
def stream_recs_sorted(spark, d):
    it = src.items(spark, d)
    return serving.sort_lists(_fallback_lists(spark, d), serving.item_profile(it, src.ratings(spark, d)), "releaseYear")


@query("csv_round_trip", "S1-S5 P6 J19 (ratings, movies, links and tags as CSV, read back and joined)", with_views("""
select r.uid, r.mid, r.score, r.ts, i.title, lpad(cast(r.mid as varchar), 7, '0') imdb_id, coalesce(t.n, 0) n_tags
from (select concat('User', cast(uid as varchar)) uid, mid, score, ts from ratings) r join items i on i.mid = r.mid
left join (select concat('User', cast(uid as varchar)) uid, mid, count(*) n from tags group by uid, mid) t on t.uid = r.uid and t.mid = r.mid""",
    "ratings", "items", "tags"))
def csv_round_trip(spark, d):
    """Writes the views in the reference's file formats and reads them with its readers."""
    root = job.scratch_root(spark, "csv")
    it = src.items(spark, d)
    tables = {
        "ratings": src.ratings(spark, d).select(F.col("uid").alias("userId"), F.col("mid").alias("movieId"), F.col("score").alias("rating"), F.col("ts").alias("timestamp")),
        "movies": it.select(F.col("mid").alias("movieId"), "title", "genres"),
        "links": it.select(F.col("mid").alias("movieId"), F.lpad(F.col("mid").cast("string"), 7, "0").alias("imdbId"), F.col("mid").cast("string").alias("tmdbId")),
        "tags": src.tags(spark, d).select(F.col("uid").alias("userId"), F.col("mid").alias("movieId"), "tag", F.col("ts").alias("timestamp"))}
    for name, df in tables.items():
        df.write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{root}/{name}")
    profile = serving.item_profile(movielens.read_movies(spark, f"{root}/movies"), movielens.read_ratings(spark, f"{root}/ratings"),
                                   movielens.read_links(spark, f"{root}/links"))
    tags = movielens.read_tags(spark, f"{root}/tags").groupBy("uid", "mid").agg(F.count(F.lit(1)).alias("n_tags"))
    titles = movielens.read_header_csv(spark, f"{root}/movies", movielens.MOVIES_SCHEMA).select(F.col("movieId").alias("mid"), "title")
    return (movielens.read_ratings(spark, f"{root}/ratings").join(profile.select("mid", F.col("imdbId").alias("imdb_id")), "mid").join(titles, "mid")
            .join(tags, ["uid", "mid"], "left")
            .select("uid", F.col("mid").cast("bigint").alias("mid"), "score", "ts", "title", "imdb_id", F.coalesce("n_tags", F.lit(0)).cast("bigint").alias("n_tags")))


@query("tags_joined", "A16 J18 S10 (items with their distinct tags joined by |)", with_views("""
select i.mid, i.title, i.genres, t.tags from items i left join (
  select mid, array_to_string(list_sort(list(distinct tag)), '|') tags from tags group by mid) t
on i.mid = t.mid""", "items", "tags"))
def tags_joined(spark, d):
    t = (src.tags(spark, d).groupBy("mid")
         .agg(F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("tags")))
    return src.items(spark, d).join(t, "mid", "left").select("mid", "title", "genres", "tags")


@query("recs_json", "S17 (genre top lists as JSON documents)", with_views("""
select genre, to_json(list({'mid': mid, 'rank': rank} order by rank)) recs from genre_top group by genre""",
    "genre_top"))
def recs_json(spark, d):
    top = stats.genre_top_n(src.items(spark, d), stats.avg_score(src.ratings(spark, d)))
    return (top.groupBy("genre")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "mid"))).alias("_l"))
            .select("genre", F.to_json(F.transform("_l", lambda x: F.struct(x["mid"].alias("mid"),
                                                                              x["rank"].alias("rank"))))
                    .alias("recs")))
