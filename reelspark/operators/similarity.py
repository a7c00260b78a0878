"""Thresholded / top-k cosine similarity.

Two exact strategies, neither materialises the cartesian product:

* ``sparse_cosine_pairs`` for term vectors (TF-IDF). Vectors that are equal
  after normalisation are collapsed to one representative. Candidates come
  from *prefix filtering* (Bayardo, Ma, Srikant, "Scaling up all pairs
  similarity search", WWW 2007): terms are ordered rare-first; a vector
  indexes only the leading terms while the norm of the remaining suffix is
  still >= threshold. If cos(x, y) > t, x's indexed prefix must share a term
  with y (Cauchy-Schwarz on the suffix), so frequent terms are seldom
  indexed and their join fan-out stays small. Candidates are then verified
  with an exact dot product. The result is kept factorised (``GroupedPairs``:
  id -> representative, representative pairs); ``expand`` emits all pairs,
  ``top_k`` and the re-ranker read through the factors instead.
* ``dense_cosine_pairs`` for dense vectors (embeddings, ALS factors). Equal
  vectors are collapsed; the others are packed into blocks of near directions
  around centres. Every block knows the range of its angles to a few pivots,
  and pairs of blocks that the triangle inequality puts further apart than the
  threshold are left out. The others go through ``operators.products``, where
  a task reads packed blocks of both sides and keeps only the pairs over the
  threshold, or k per vector. Vectors without clusters leave all pairs of
  blocks; then the work (not what is shuffled) is as quadratic as the
  definition.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.operators.products import WHOLE, best_products, block_rows as rows_of_block, low_rows, near_rows
from reelspark.operators.topk import top_k_per_group
from reelspark.session import bound_arrow_batches, checkpoint_dir

DEFAULT_BLOCK_ROWS = 2048
#: Pivots that bound angles, a bounded choice that only costs depend on.
PIVOTS = 32


# --------------------------------------------------------------------------- TF-IDF

def genre_terms(items: DataFrame) -> DataFrame:
    """Tokenizer on genres with ``|`` read as space: lower-cased whitespace tokens."""
    toks = F.split(F.lower(F.translate(F.col("genres"), "|", " ")), r"\s")
    return items.select("mid", F.explode(toks).alias("term")).where(F.col("term") != "")


def tfidf(terms: DataFrame, doc_col: str = "mid") -> DataFrame:
    """F9 without hashing: tf per (doc, term), idf = ln((N + 1) / (df + 1)) as in
    Spark ML's IDF, weight = tf * idf. N (one number) is counted up front."""
    tf = terms.groupBy(doc_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    n_docs = F.lit(terms.select(doc_col).distinct().count())
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("term", F.log((n_docs + 1).cast("double") / (F.col("df") + 1)).alias("idf"))
    return tf.join(idf, "term").select(doc_col, "term", "tf", "idf", (F.col("tf") * F.col("idf")).alias("w"))


def hashed_tfidf(items: DataFrame, num_features: int = 20, doc_col: str = "mid") -> DataFrame:
    """F9 as the reference runs it: ML ``Tokenizer`` on genres with ``|`` as
    space, ``HashingTF(num_features)`` (colliding terms share a bucket),
    ``IDF``; the sparse vectors are exploded to (doc, term index, weight).
    Fitting IDF aggregates document frequencies per bucket (a vector of
    ``num_features`` counts), nothing per document reaches the driver. The
    explode goes through a dense array of ``num_features`` slots, meant for
    the reference's small bucket counts; large vocabularies use ``tfidf``
    (exact terms, sparse rows)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Tokenizer
    from pyspark.ml.functions import vector_to_array

    docs = items.select(doc_col, F.translate(F.col("genres"), "|", " ").alias("_text"))
    model = Pipeline(stages=[Tokenizer(inputCol="_text", outputCol="_tok"),
                             HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
                             IDF(inputCol="_tf", outputCol="_w")]).fit(docs)
    w = model.transform(docs).select(doc_col, vector_to_array("_w").alias("_w"))
    return (w.select(doc_col, F.posexplode("_w").alias("term", "w")).where(F.col("w") != 0)
            .select(doc_col, F.col("term").cast("string").alias("term"), "w"))


# --------------------------------------------------------------------------- sparse cosine

@dataclass
class GroupedPairs:
    """A similarity table in factorised form: ``members`` maps each id to the
    representative of its group of equal vectors (``id, _rep``); ``rep_pairs``
    holds (``_a, _b, score``) between representatives, including ``(r, r, 1.0)``.
    ``sim(x, y) = rep_pairs(rep(x), rep(y))`` for x != y. Equal vectors make the
    expanded table quadratic in group size; consumers that need only some
    pairs join through the factors instead of expanding everything."""
    members: DataFrame
    rep_pairs: DataFrame
    id_col: str = "mid"

    def expand(self, other_col: str = "sim_mid") -> DataFrame:
        """All ordered pairs (id, other, score), id != other."""
        ma = self.members.select(F.col(self.id_col), F.col("_rep").alias("_a"))
        mb = self.members.select(F.col(self.id_col).alias(other_col), F.col("_rep").alias("_b"))
        return (self.rep_pairs.join(ma, "_a").join(mb, "_b")
                .where(F.col(self.id_col) != F.col(other_col)).select(self.id_col, other_col, "score"))


    def top_k(self, k: int, other_col: str = "sim_mid", tie_places: int = 9) -> DataFrame:
        """The k best partners per id (score desc, ties on the rounded score by
        partner id asc) without expanding all pairs: members of one group share
        every score, so only the k + 1 smallest ids of each partner group can
        be chosen (one slot for the id itself). Rows ``id, other, score, rank``."""
        first = top_k_per_group(self.members.select(F.col(self.id_col).alias(other_col), F.col("_rep").alias("_b")),
                                ["_b"], [F.col(other_col).asc()], k + 1, "_r").drop("_r")
        # So do all members of the id's own group: their lists are the group's k + 1 best, each without itself.
        shown = F.round("score", tie_places)
        best = top_k_per_group(self.rep_pairs.join(first, "_b"), ["_a"], [shown.desc(), F.col(other_col).asc()], k + 1, "_r")
        lists = best.groupBy("_a").agg(F.array_sort(F.collect_list(F.struct("_r", F.col(other_col).alias("_o"), "score"))).alias("_l"))
        ma = self.members.select(F.col(self.id_col), F.col("_rep").alias("_a"))
        own = F.slice(F.filter("_l", lambda x: x["_o"] != F.col(self.id_col)), 1, k)
        return (ma.join(lists, "_a").select(self.id_col, F.posexplode(own).alias("_p", "_x"))
                .select(self.id_col, F.col("_x._o").alias(other_col), "_x.score", (F.col("_p") + 1).cast("bigint").alias("rank")))


def as_grouped(sims, id_col: str = "mid", other_col: str = "sim_mid") -> GroupedPairs:
    """A plain pairs table as a factorised one (every id its own group)."""
    if isinstance(sims, GroupedPairs):
        return sims
    ids = sims.select(F.col(id_col)).union(sims.select(F.col(other_col).alias(id_col))).distinct()
    return GroupedPairs(ids.select(id_col, F.col(id_col).alias("_rep")),
                        sims.select(F.col(id_col).alias("_a"), F.col(other_col).alias("_b"), "score"), id_col)


def sparse_cosine_groups(entries: DataFrame, threshold: float, id_col: str = "mid") -> GroupedPairs:
    """Cosine > ``threshold`` between term vectors, factorised (see GroupedPairs).

    ``entries`` holds (id, term, w) with w > 0. Exact for 0 < threshold < 1.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must be in (0, 1)")
    # Equal vectors are collapsed on the weights as given, before any sum is rounded: the signature is the sorted
    # (term, weight) list, and norms and products add up in term order, so that no shuffle order shows in the result.
    checkpoint_dir(entries.sparkSession)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    sig = (entries.where(F.col("w") != 0).groupBy(id_col)
           .agg(F.array_sort(F.collect_list(F.struct("term", F.col("w").cast("double").alias("w")))).alias("_sig")).checkpoint())
    rep = sig.groupBy("_sig").agg(F.min(id_col).alias("_rep")).checkpoint()
    members = sig.join(rep, "_sig").select(id_col, "_rep")
    norm = F.sqrt(total(F.transform("_sig", lambda x: x["w"] * x["w"])))
    reps = rep.select(F.col("_rep").alias(id_col), norm.alias("_norm"), F.inline("_sig")).select(id_col, "term", (F.col("w") / F.col("_norm")).alias("w"))

    # Prefix per representative: rare terms first; index while suffix norm >= t (with room for rounding).
    dfreq = reps.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    w_suffix = (Window.partitionBy(id_col).orderBy(F.col("_df").asc(), F.col("term").asc())
                .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    prefix = (reps.join(dfreq, "term")
              .withColumn("_suffix", F.sqrt(F.sum(F.col("w") * F.col("w")).over(w_suffix)))
              .where(F.col("_suffix") >= threshold - 1e-9).select(F.col(id_col).alias("_a"), "term"))
    full = reps.select(F.col(id_col).alias("_b"), "term")
    cand = (prefix.join(full, "term").where(F.col("_a") != F.col("_b"))
            .select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct())

    wa = reps.select(F.col(id_col).alias("_a"), "term", F.col("w").alias("_wa"))
    wb = reps.select(F.col(id_col).alias("_b"), "term", F.col("w").alias("_wb"))
    products = F.array_sort(F.collect_list(F.struct("term", (F.col("_wa") * F.col("_wb")).alias("p"))))
    scored = (cand.join(wa, "_a").join(wb, ["_b", "term"]).groupBy("_a", "_b").agg(products.alias("_p"))
              .select("_a", "_b", total(F.col("_p.p")).alias("score")).where(F.col("score") > threshold))
    # Members of one signature are equal vectors: cosine 1 with each other.
    selfs = rep.select(F.col("_rep").alias("_a"), F.col("_rep").alias("_b"), F.lit(1.0).alias("score"))
    rep_pairs = (scored.unionByName(scored.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"), "score"))
                 .unionByName(selfs))
    # Both factors are read several times by consumers; a reliable checkpoint
    # (items-sized, not pairs-sized) computes them once and cuts the lineage.
    return GroupedPairs(members.checkpoint(eager=True), rep_pairs.checkpoint(eager=True), id_col)


def sparse_cosine_pairs(entries: DataFrame, threshold: float, id_col: str = "mid",
                        other_col: str = "sim_mid") -> DataFrame:
    """All ordered pairs (id, other, score) with cosine > ``threshold``, id != other."""
    return sparse_cosine_groups(entries, threshold, id_col).expand(other_col)


# --------------------------------------------------------------------------- dense cosine

def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pack(pivots: np.ndarray):
    """A block as one row, with the least and largest angle of its vectors to each pivot."""
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("_id").to_numpy()
        order = np.argsort(ids)
        v = _vectors(table.column("_v").combine_chunks())[order]
        angle = np.arccos(np.clip(v @ pivots.T, -1, 1))
        binary = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
        return pa.table({"_blk": table.column("_blk").slice(0, 1), "ids": binary(ids[order]), "vecs": binary(v),
                         "lo": pa.array([angle.min(axis=0).tolist()]), "hi": pa.array([angle.max(axis=0).tolist()])})
    return run


@dataclass
class Blocks:
    """Unit vectors packed into blocks of near directions (``_blk, ids, vecs, lo, hi``), and their number."""
    packed: DataFrame
    number: int

    def pairs(self, threshold: float | None) -> DataFrame:
        """(a_block, b_block), a <= b, of the blocks that can hold a pair of
        cosine over ``threshold``. By the triangle inequality on the sphere two
        vectors are at least as far apart as their angles to any pivot differ;
        a pair of blocks goes if those angles stay further apart than the
        threshold's for some pivot."""
        stats = self.packed.select(F.col("_blk").alias("b_block"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
        every = self.packed.select(F.col("_blk").alias("a_block"), "lo", "hi", F.explode(F.sequence(F.col("_blk"), F.lit(self.number - 1))).alias("b_block"))
        both = every.join(stats, "b_block")
        if threshold is not None:
            apart = F.greatest(F.array_max(F.zip_with("lo", "hi_b", lambda x, y: x - y)), F.array_max(F.zip_with("lo_b", "hi", lambda x, y: x - y)))
            both = both.where((F.col("a_block") == F.col("b_block")) | (apart <= math.acos(max(-1.0, min(1.0, threshold))) + 1e-9))
        return both.select("a_block", "b_block")


def direction_blocks(v: DataFrame, n: int, block_rows: int) -> Blocks:
    """``v`` (_id, _v unit vectors, distinct ids; n rows) in blocks of about
    ``block_rows``: cells around centres, the vectors with the least hashes;
    cells that are too large are split by hash."""
    blocks, c, number = near_rows(v, n, block_rows)
    packed = blocks.groupBy("_blk").applyInArrow(_pack(c[:PIVOTS]), "_blk int, ids binary, vecs binary, lo array<double>, hi array<double>")
    return Blocks(packed.checkpoint(), number)


def dense_cosine_pairs(df: DataFrame, id_col: str, vec_col: str, threshold: float | None = None,
                       k: int | None = None, other_col: str = "sim_id",
                       block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Ordered pairs (id, other, score) of cosine > ``threshold``; with ``k``, the
    k best partners per id (ties: smaller other id). Exact; zero vectors skipped.

    Plan: equal vectors become one -> blocks of near directions -> pairs of
    blocks that the pivots do not rule out -> ``best_products`` over pairs of
    blocks -> global top-k by window (partial WindowGroupLimit) -> members of
    equal vectors. Counts, the centres (MOST_CENTRES vectors at most) and the
    vector length reach the driver.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    bound_arrow_batches(spark)
    raw = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vec_col).cast("array<double>").alias("_raw"))
    raw = raw.withColumn("_n", F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda acc, x: acc + x * x))).where(F.col("_n") > 0)
    groups = raw.groupBy("_raw").agg(F.min("_id").alias("_id"), F.first("_n").alias("_n"), F.count(F.lit(1)).alias("_m")).checkpoint()
    stats = groups.agg(F.count(F.lit(1)).alias("n"), F.sum("_m").alias("rows"), F.max(F.size("_raw")).alias("dim"),
                       F.min(F.size("_raw")).alias("dim_min")).first()
    n = stats["n"]
    if not n:
        return spark.createDataFrame([], f"{id_col} bigint, {other_col} bigint, score double" + (", rank bigint" if k is not None else ""))
    if stats["dim"] != stats["dim_min"]:
        raise ValueError("vectors of unequal length")
    v = groups.select("_id", F.transform("_raw", lambda x: x / F.col("_n")).alias("_v"))
    low = stats["dim"] <= WHOLE  # cells of near rows bound their products, blocks may be larger
    most = low_rows(spark, n, block_rows) if low else block_rows
    blocks = direction_blocks(v, n, rows_of_block(stats["dim"], most))
    packed = blocks.packed.select(F.col("_blk").alias("block"), "ids", "vecs")
    partners = None
    if threshold is not None and not low:
        near = blocks.pairs(threshold)
        both = near.union(near.where("a_block <> b_block").select("b_block", "a_block"))
        partners = both.groupBy(F.col("a_block").alias("block")).agg(F.collect_list("b_block").alias("partners"))
    order = [F.col("score").desc(), F.col(other_col).asc()]
    out = best_products(packed, packed, blocks.number, blocks.number, stats["dim"], k, floor=-math.inf if threshold is None else threshold, not_self=True, partners=partners)
    out = out.withColumnsRenamed({"l": id_col, "r": other_col})
    if stats["rows"] == n:
        return out
    # equal vectors: each member has the partners of the least, and the other members
    members = raw.join(groups.select("_raw", F.col("_id").alias("_rep")), "_raw").select("_id", "_rep")
    own = groups.select(F.col("_id").alias("_a"), F.col("_id").alias("_b"), F.lit(1.0).alias("score"))
    near = out.select(F.col(id_col).alias("_a"), F.col(other_col).alias("_b"), "score")
    near = near.unionByName(own if threshold is None or threshold < 1 else own.limit(0))
    partners = members.select(F.col("_id").alias(other_col), F.col("_rep").alias("_b"))
    if k is not None:  # of a group only the k + 1 least ids can be among the k best
        partners = top_k_per_group(partners, ["_b"], [F.col(other_col).asc()], k + 1, "_r").drop("_r")
    full = (members.select(F.col("_id").alias(id_col), F.col("_rep").alias("_a")).join(near, "_a").join(partners, "_b")
            .where(F.col(id_col) != F.col(other_col)).select(id_col, other_col, "score"))
    return top_k_per_group(full, [id_col], order, k) if k is not None else full
