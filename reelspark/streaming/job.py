"""The streaming re-ranker as one checkpointed Structured Streaming query (ST1-ST9, S11, S15, S16).

source (text lines: a folder; records of a topic: ``streaming.topic``)
  -> filter_log / parse_messages                     (ST2, ST3)
  -> groupBy(uid).transformWithState                 (ST4, ST5, ST9, S16: recent list, rated items)
  -> foreachBatch(upsert_batch)                      (ST6-ST8, S15: candidates, scores, lists)

What the job knows of a user is keyed state: a list of the 40 newest events by
``EVENT_ORDER``, and a map of the rated items, each with its newest rating. A
micro-batch touches the state of its own users only, whatever the age of the
stream. Events arrive as an iterator of Arrow batches in any order; a running
selection of the 40 newest makes the state independent of batch size, file
order and how the log was cut: an event that arrives late takes the place its
time stamp gives it, and one older than the 40 newest only counts as rated.

State lives in the query's checkpoint and can be read from there with Spark's
state reader (``current_ratings``, ``recent_lists``). Lists go to a Parquet
table with a folder per batch (``v=N``), which a batch that runs again
overwrites; the newest version of a user's list counts.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelspark.operators.upsert import last_write_wins
from reelspark.session import checkpoint_dir
from reelspark.streaming.rerank import (MAX_USER_RATINGS_NUM, RECENT_LIST_CAP, candidate_scores, candidates, filter_log,
                                        parse_messages)

EVENT_SCHEMA = "uid long, mid long, score double, ts long"
#: Once per user and batch the newest events, and a row (recent empty) for each item the user has rated.
STATE_OUT_SCHEMA = "uid long, mid long, recent array<struct<mid:long,score:double>>"
LIST_SCHEMA = "array<struct<rank:long,mid:long,score:double>>"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rated items sent on together, and most of a user's that are looked up in one read of the state.
CHUNK = 10_000


def newest_events(kept: list[tuple], pdfs: Iterator[pd.DataFrame]) -> Iterator[tuple[list[tuple], dict]]:
    """After each chunk of events: the 40 newest (ts, mid, score) so far, and the chunk's newest (ts, score) per item."""
    for pdf in pdfs:
        events = list(zip(pdf["ts"].tolist(), pdf["mid"].tolist(), pdf["score"].tolist(), strict=True))
        kept = heapq.nlargest(RECENT_LIST_CAP, [*kept, *heapq.nlargest(RECENT_LIST_CAP, events)])
        rated: dict = {}
        for ts, mid, score in events:
            rated[mid] = max(rated.get(mid, (ts, score)), (ts, score))
        yield kept, rated


class UserState(StatefulProcessor):
    """ST4, ST5, ST9: a user's 40 newest events and the items the user has rated."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._recent = handle.getListState("recent", "ts long, mid long, score double")
        self._rated = handle.getMapState("rated", "mid long", "ts long, score double")

    def _rate(self, rated: dict, known: dict | None) -> dict | None:
        """``known``: the user's items as kept, or None if there are over CHUNK,
        which are looked up one by one (a call to the state store each)."""
        for mid, new in rated.items():
            if known is not None:
                old = known.get(mid)
            else:
                old = tuple(self._rated.getValue((mid,))) if self._rated.containsKey((mid,)) else None
            if old is None or old < new:
                self._rated.updateValue((mid,), new)
                if known is not None:
                    known[mid] = new
        return known if known is None or len(known) <= CHUNK else None

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Ratings from before the stream's first event count as rated, not as recent."""
        for _, rated in newest_events([], iter([initialState])):
            self._rate(rated, None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest: list[tuple] = [tuple(r) for r in self._recent.get()]
        known: dict | None = {k[0]: tuple(v) for k, v in islice(self._rated.iterator(), CHUNK + 1)}
        known = known if len(known) <= CHUNK else None
        for newest, rated in newest_events(newest, rows):
            known = self._rate(rated, known)
        self._recent.put(newest)
        uid = key[0]
        # The newest events come first, in one frame with the first rated items.
        chunk, recents = [newest[0][1]], [[{"mid": m, "score": s} for _, m, s in newest[:MAX_USER_RATINGS_NUM]]]
        for mid in known if known is not None else (k[0] for k in self._rated.keys()):  # noqa: SIM118
            chunk.append(mid)
            recents.append([])
            if len(chunk) >= CHUNK:
                yield pd.DataFrame({"uid": uid, "mid": chunk, "recent": recents})
                chunk, recents = [], []
        if chunk:
            yield pd.DataFrame({"uid": uid, "mid": chunk, "recent": recents})

    def close(self) -> None:
        pass


def rating_events(lines: DataFrame, col: str = "value") -> DataFrame:
    """Streaming (or batch) text lines to typed rating events."""
    return parse_messages(filter_log(lines, col)).select("uid", "mid", "score", "ts")


def with_user_state(events: DataFrame, base_ratings: DataFrame | None = None) -> DataFrame:
    """The keyed step; ``base_ratings`` (uid, mid, score, ts) is the history
    before the stream's first event, read by the first batch only."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    base = base_ratings.select("uid", "mid", "score", "ts").groupBy("uid") if base_ratings is not None else None
    return events.groupBy("uid").transformWithStateInPandas(UserState(), STATE_OUT_SCHEMA, "append", "None", initialState=base)


def init_output(spark: SparkSession, root: str) -> None:
    """Make the output folder's table unless it is there."""
    spark.createDataFrame([], f"uid long, recs {LIST_SCHEMA}").write.mode("ignore").parquet(f"{root.rstrip('/')}/recs/v=-1")


def upsert_batch(out_root: str, sims):
    """``foreachBatch`` body (ST6-ST8, S15).

    The newest event of each user of the batch is scored against the similarity
    table, without the items the user has rated. Every user of the batch gets a
    new list row (possibly empty: the old list is replaced, S15) in version
    ``batch_id`` of ``recs``.
    """
    root = out_root.rstrip("/")

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        newest = batch.where("size(recent) > 0").select("uid", "mid", "recent")
        seen = batch.where("size(recent) = 0").select("uid", "mid")
        recents = newest.select("uid", F.explode("recent").alias("_r")).select("uid", "_r.mid", "_r.score")
        cands = candidates(newest.select("uid", "mid"), seen, sims)
        lists = (candidate_scores(cands, recents, sims)
                 .groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "mid", "score"))).alias("recs")))
        rows = (newest.select("uid").join(lists, "uid", "left")
                .select("uid", F.coalesce("recs", F.array().cast(LIST_SCHEMA)).alias("recs")))
        rows.write.mode("overwrite").parquet(f"{root}/recs/v={batch_id}")
        batch.unpersist()
    return run


def read_lists(spark: SparkSession, out_root: str, upto: int = 1 << 62) -> DataFrame:
    """Current lists: the newest version per user, one row per entry
    (``uid, rank, mid, score``); users whose newest list is empty have none."""
    d = spark.read.schema(f"uid long, recs {LIST_SCHEMA}, v long").parquet(f"{out_root.rstrip('/')}/recs").where(F.col("v") <= upto)
    newest = last_write_wins(d, ["uid"], ["v"], ["recs"])
    return newest.select("uid", F.explode("recs").alias("_r")).select("uid", "_r.rank", "_r.mid", "_r.score")


def _state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


def current_ratings(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The newest rating of each (uid, mid) after all committed batches, from the query's state."""
    return _state(spark, checkpoint, "rated").select("key.uid", F.col("user_map_key.mid").alias("mid"), "user_map_value.score", "user_map_value.ts")


def recent_lists(spark: SparkSession, checkpoint: str) -> DataFrame:
    """ST4: the recent events of each user (uid, mid, score, ts), from the query's state."""
    return _state(spark, checkpoint, "recent").select("key.uid", "list_element.mid", "list_element.score", "list_element.ts")


def start(spark: SparkSession, source_dir: str, out_root: str, checkpoint: str, sims: DataFrame,
          base_ratings: DataFrame | None = None, trigger: dict | None = None,
          files_per_trigger: int | None = None, fmt: str = "text", options: dict | None = None):
    """Start the query. The default reads text files from ``source_dir``;
    ``fmt='topic'`` reads a topic (``streaming.topic``) there, ``fmt='kafka'``
    with ``options`` a broker when its package is on the classpath (ST1 trigger:
    2 s processing time unless ``trigger`` says otherwise, e.g.
    ``{'availableNow': True}``)."""
    init_output(spark, out_root)
    reader = spark.readStream.format(fmt)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    if fmt == "text":
        reader = reader.option("recursiveFileLookup", "true")
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        lines = reader.load(source_dir)
    else:
        lines = (reader.load(source_dir) if source_dir else reader.load()).select(F.col("value").cast("string").alias("value"))
    stream = with_user_state(rating_events(lines), base_ratings)
    writer = (stream.writeStream.foreachBatch(upsert_batch(out_root, sims))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(**(trigger or {"processingTime": "2 seconds"}))
    return writer.start()


def start_log_filter(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, trigger: dict | None = None):
    """S12 over files: log lines in, the rating messages they carry out
    (append-only Parquet); ``topic.start_topic_filter`` goes from topic to topic."""
    lines = spark.readStream.format("text").load(source_dir)
    writer = (filter_log(lines, "value").select("message").writeStream.format("parquet")
              .option("path", out_dir).option("checkpointLocation", checkpoint))
    return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def scratch_root(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's reliable checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
