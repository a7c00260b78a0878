"""Content and embedding similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions.columns import rounded
from reelspark.operators import similarity as sim
from reelspark.plans.catalog import query
from reelspark.plans.oracle import with_views
from reelspark.sources import driver_tables as src

# Thresholds of the reference's similarity jobs.
CONTENT_THRESHOLD = 0.6
# The 64-float embeddings of the driver data peak at cosine 0.513, so the
# reference's 0.6 / 0.7 would give no rows; 0.3 exercises the operator.
EMBEDDING_THRESHOLD = 0.3
TOP_SIMILAR = 10

TFIDF_SQL = """
with tf as (
  select mid, term, count(*) tf
  from items, unnest(string_split(lower(replace(genres, '|', ' ')), ' ')) t(term)
  where term <> '' group by mid, term),
nd as (select count(distinct mid) n from tf),
dfreq as (select term, count(*) df from tf group by term)
select tf.mid, tf.term, tf.tf, ln((nd.n + 1.0) / (dfreq.df + 1.0)) idf,
       tf.tf * ln((nd.n + 1.0) / (dfreq.df + 1.0)) w
from tf join dfreq on tf.term = dfreq.term, nd"""


@query("tfidf_terms", "F9 (Tokenizer + TF + IDF, un-hashed vocabulary)", with_views(
    "select mid, term, tf, round(idf, 6) idf, round(w, 6) tfidf from tw", "items", extra={"tw": TFIDF_SQL}))
def tfidf_terms(spark, d):
    t = sim.tfidf(sim.genre_terms(src.items(spark, d)))
    return t.select("mid", "term", "tf", rounded(F.col("idf")).alias("idf"), rounded(F.col("w")).alias("tfidf"))


CONTENT_SIM_SQL = """
with nrm as (select mid, sqrt(sum(w * w)) nrm from tw group by mid),
wn as (select tw.mid, tw.term, tw.w / nrm.nrm w from tw join nrm on tw.mid = nrm.mid where nrm.nrm > 0 and tw.w <> 0)
select a.mid, b.mid sim_mid, round(sum(a.w * b.w), 6) score
from wn a join wn b on a.term = b.term and a.mid <> b.mid
group by a.mid, b.mid having sum(a.w * b.w) > 0.6"""


# The factorised table: each item's representative (the least item of equal vectors) and the pairs of
# representatives; the table of all item pairs is their product and grows with the square of the groups.
CONTENT_GROUPS_SQL = """
with sig as (select mid, list(term || ':' || tf order by term) s from tw where w <> 0 group by mid),
rep as (select s, min(mid) rep from sig group by s),
mem as (select sig.mid, rep.rep from sig join rep on sig.s = rep.s),
twr as (select tw.* from tw where mid in (select rep from rep)),
nrm as (select mid, sqrt(sum(w * w)) nrm from twr group by mid),
wn as (select twr.mid, twr.term, twr.w / nrm.nrm w from twr join nrm on twr.mid = nrm.mid where nrm.nrm > 0 and twr.w <> 0)
select 'member' kind, mid a, rep b, 1.0 score from mem
union all
select 'pair' kind, a.mid a, b.mid b, round(sum(a.w * b.w), 6) score
from wn a join wn b on a.term = b.term and a.mid <> b.mid
group by a.mid, b.mid having sum(a.w * b.w) > 0.6
union all
select 'pair' kind, rep a, rep b, 1.0 score from rep"""


def _factored(groups):
    """kind 'member': item a has representative b; kind 'pair': representatives a, b with their cosine."""
    members = groups.members.select(F.lit("member").alias("kind"), F.col(groups.id_col).alias("a"), F.col("_rep").alias("b"), F.lit(1.0).alias("score"))
    pairs = groups.rep_pairs.select(F.lit("pair").alias("kind"), F.col("_a").alias("a"), F.col("_b").alias("b"), rounded(F.col("score")).alias("score"))
    return members.unionByName(pairs)


@query("content_similar", "J10 F15 T5 P8 P9 (TF-IDF cosine > 0.6, all partners, as members and representative pairs)",
       with_views(CONTENT_GROUPS_SQL, "items", extra={"tw": TFIDF_SQL}))
def content_similar(spark, d):
    t = sim.tfidf(sim.genre_terms(src.items(spark, d)))
    return _factored(sim.sparse_cosine_groups(t.select("mid", "term", "w"), CONTENT_THRESHOLD))


@query("content_similar_hashed", "F9 J10 T5 (HashingTF(20) + IDF as in the reference; cosine > 0.6; factorised)")
def content_similar_hashed(spark, d):
    w = sim.hashed_tfidf(src.items(spark, d), num_features=20)
    return _factored(sim.sparse_cosine_groups(w, CONTENT_THRESHOLD))


EMB_COS = ("list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[]))")


@query("embedding_similar", "F15 J8 P8 P9 (dense cosine > 0.3 on embeddings)", f"""
select a.vec_id, b.vec_id sim_id, round({EMB_COS}, 6) score
from embeddings a join embeddings b on a.vec_id <> b.vec_id where {EMB_COS} > 0.3""")
def embedding_similar(spark, d):
    e = src.table(spark, d, "embeddings")
    p = sim.dense_cosine_pairs(e, "vec_id", "embedding", threshold=EMBEDDING_THRESHOLD, other_col="sim_id")
    return p.select("vec_id", "sim_id", rounded(F.col("score")).alias("score"))


@query("embedding_topk", "F11 T4 (10 nearest vectors per vector)", f"""
select vec_id, rank, sim_id, score from (
  select a.vec_id, b.vec_id sim_id, round({EMB_COS}, 6) score,
         cast(row_number() over (partition by a.vec_id order by {EMB_COS} desc, b.vec_id) as bigint) rank
  from embeddings a join embeddings b on a.vec_id <> b.vec_id) t where rank <= 10""")
def embedding_topk(spark, d):
    e = src.table(spark, d, "embeddings")
    p = sim.dense_cosine_pairs(e, "vec_id", "embedding", k=TOP_SIMILAR, other_col="sim_id")
    return p.select("vec_id", "rank", "sim_id", rounded(F.col("score")).alias("score"))
