"""Log parsing and similarity re-ranking (S12-S14, ST2, ST3, ST5-ST7, A22, J14, J15, T6, T14).

The batch functions here are the replay form of the streaming job in
``reelspark.streaming.job``: over the same messages both give the same
final recommendation lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.columns import RATING_LOG_PREFIX, STRONG_RATING_THRESHOLD, log10_at_least_one
from reelspark.operators.similarity import as_grouped
from reelspark.operators.topk import top_k_per_group
from reelspark.operators.upsert import last_write_wins

# The reference's streaming parameters.
MAX_USER_RATINGS_NUM = 20      # recent ratings read per event
RECENT_LIST_CAP = 40           # recent ratings kept per user
MAX_SIM_MOVIES_NUM = 10        # candidates per event
SIM_THRESHOLD = 0.7            # similarity needed for a recent rating to count

EVENT_ORDER = ("ts", "mid", "score")   # total order of rating events
# Similarities and scores closer than 1e-9 rank as ties (then by item id):
# a sum computed in another order must not reorder the lists.
TIE_PLACES = 9


def filter_log(lines: DataFrame, col: str = "line", prefix: str = RATING_LOG_PREFIX) -> DataFrame:
    """S12/S13/ST2/P12: keep lines containing the prefix; the message is the
    trimmed text between its first and any second occurrence."""
    return (lines.where(F.col(col).contains(prefix))
            .withColumn("message", F.trim(F.split_part(F.col(col), F.lit(prefix), F.lit(2)))))


def parse_messages(messages: DataFrame, col: str = "message") -> DataFrame:
    """ST3/P6/P15: ``uid|mid|score|ts`` to typed columns; rows with another
    field count or an unparsable field are dropped.

    The fields come from a generator over the split message: conditions on them
    are not moved below it, so that a message is built and split once and not
    once more for every condition."""
    names = {"uid": "bigint", "mid": "bigint", "score": "double", "ts": "bigint"}
    typed = F.transform(F.array(F.split(F.col(col), r"\|")), lambda p: F.struct(
        F.size(p).alias("_nf"), *[F.trim(F.get(p, i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(names.items())]))
    rows = messages.select("*", F.inline(typed))
    ok = (F.col("_nf") == 4) & F.col("uid").isNotNull() & F.col("mid").isNotNull() \
        & F.col("score").isNotNull() & F.col("ts").isNotNull()
    return rows.where(ok).drop("_nf")


def rating_log_line(uid: Column, mid: Column, score: Column, ts: Column) -> Column:
    """The application log line of a rating event."""
    return F.concat(F.lit(RATING_LOG_PREFIX),
                    F.concat_ws("|", uid.cast("string"), mid.cast("string"), score.cast("string"),
                                ts.cast("string")))


def recent_ratings(events: DataFrame, k: int = MAX_USER_RATINGS_NUM) -> DataFrame:
    """The k newest rating events per user, newest first (repeats kept).
    Rows ``uid, rank, mid, score`` (partial top-k per task)."""
    order = [F.col(c).desc() for c in EVENT_ORDER]
    return top_k_per_group(events.select("uid", "mid", "score", "ts"), ["uid"], order, k).drop("ts")


def last_events(events: DataFrame) -> DataFrame:
    """The newest event per user (``uid, mid``), by max over the event order."""
    return last_write_wins(events, ["uid"], list(EVENT_ORDER), ["mid"])


def candidates(last: DataFrame, seen: DataFrame, sims, n: int = MAX_SIM_MOVIES_NUM) -> DataFrame:
    """ST6/J15/T6: items similar to the user's last rated item that the user has
    not rated, most similar first (ties: item id), first n. An item without a
    similarity row gives no candidates (the reference throws).
    ``sims`` is a pairs table (mid, sim_mid, score) or a ``GroupedPairs``; only
    the partners of the users' last items are expanded. Rows ``uid, rank, mid, sim``."""
    g = as_grouped(sims)
    rep_of = g.members.select(F.col(g.id_col).alias("_src"), F.col("_rep").alias("_a"))
    src_rep = last.select("uid", F.col("mid").alias("_src")).join(rep_of, "_src")
    groups = src_rep.join(g.rep_pairs, "_a").select("uid", "_src", "_b", F.col("score").alias("sim"))
    # Members of a group share their similarity and come in id order, so of a
    # group with s seen members only the first n + 1 + s can be chosen.
    ranked = g.members.select(F.col(g.id_col).alias("mid"), F.col("_rep").alias("_b"),
                              F.row_number().over(Window.partitionBy("_rep").orderBy(g.id_col)).alias("_m"))
    had = seen.select("uid", "mid").distinct()
    taken = (had.join(ranked.select("mid", "_b"), "mid").groupBy("uid", "_b").agg(F.count(F.lit(1)).alias("_s")))
    groups = groups.join(taken, ["uid", "_b"], "left").withColumn("_m", F.explode(F.sequence(F.lit(1), n + 1 + F.coalesce("_s", F.lit(0)).cast("int"))))
    partners = (groups.join(ranked, ["_b", "_m"]).where(F.col("mid") != F.col("_src")).select("uid", "mid", "sim"))
    c = partners.join(had, ["uid", "mid"], "left_anti")
    return top_k_per_group(c, ["uid"], [F.round("sim", TIE_PLACES).desc(), F.col("mid").asc()], n)


def candidate_scores(cands: DataFrame, recents: DataFrame, sims,
                     sim_threshold: float = SIM_THRESHOLD,
                     strong: float = STRONG_RATING_THRESHOLD) -> DataFrame:
    """A22/J14/ST7: score(c) = mean(sim(c, r) * score_r) over the user's recent
    ratings r with sim > threshold, + log10(max(#strong, 1)) - log10(max(#weak, 1)),
    strong meaning score_r > 3. Missing similarity (and c = r) counts as 0; a
    candidate with no qualifying recent rating is dropped.
    Rows ``uid, rank, mid, score``.

    Per user this joins at most (candidates x recents) = 10 x 20 rows, and
    looks up each pair's similarity through the factors.
    """
    g = as_grouped(sims)
    rep_of = g.members.select(F.col(g.id_col).alias("_k"), "_rep")
    pairs = (cands.select("uid", "mid")
             .join(recents.select("uid", F.col("mid").alias("_r"), F.col("score").alias("_rs")), "uid")
             .join(rep_of.select(F.col("_k").alias("mid"), F.col("_rep").alias("_a")), "mid", "left")
             .join(rep_of.select(F.col("_k").alias("_r"), F.col("_rep").alias("_b")), "_r", "left")
             .join(g.rep_pairs.select("_a", "_b", F.col("score").alias("_sim")), ["_a", "_b"], "left")
             .withColumn("_sim", F.when(F.col("mid") == F.col("_r"), F.lit(0.0))
                         .otherwise(F.coalesce("_sim", F.lit(0.0))))
             .where(F.col("_sim") > sim_threshold))
    agg = pairs.groupBy("uid", "mid").agg(
        F.avg(F.col("_sim") * F.col("_rs")).alias("_base"),
        F.count_if(F.col("_rs") > strong).alias("_inc"),
        F.count_if(F.col("_rs") <= strong).alias("_dec"))
    scored = agg.select("uid", "mid", (F.col("_base") + log10_at_least_one(F.col("_inc"))
                                       - log10_at_least_one(F.col("_dec"))).alias("score"))
    order = Window.partitionBy("uid").orderBy(F.round("score", TIE_PLACES).desc(), F.col("mid").asc())
    return scored.select("uid", F.row_number().over(order).cast("bigint").alias("rank"), "mid", "score")


def rerank_batch(events: DataFrame, sims: DataFrame) -> DataFrame:
    """Replay of the streaming job: every user's list as left by the user's
    newest event. Rows ``uid, rank, mid, score``."""
    cands = candidates(last_events(events), events, sims)
    return candidate_scores(cands, recent_ratings(events), sims)
