"""Table sinks.

The reference overwrites document-store collections and builds a secondary
index on the lookup key; here a result table is a parquet folder laid out
by its lookup key, so a point lookup reads one file's row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, key: str | None = None, partitions: int | None = None) -> None:
    """Overwrite ``path``; with ``key``, range-partition and sort by it so
    parquet min/max statistics prune row groups on ``key = v`` lookups."""
    if key is not None:
        n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(n, key).sortWithinPartitions(key)
    df.write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """A bucketed, sorted catalog table with Parquet bloom filters on the
    key (below ``path`` if given). Joins on ``key`` read it without a shuffle, a
    point lookup reads one bucket, and a bucket's files skip row groups that do
    not hold the key. Rows are dealt by the key first: one file per bucket."""
    writer = (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
              .option(f"parquet.bloom.filter.enabled#{key}", "true"))
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def export_samples_csv(samples: DataFrame, path: str, single_file: bool = False) -> None:
    """``userIdx,movieIdx,score`` with a header, ordered by user index.
    One file only on request (it funnels the data through one task)."""
    out = samples.select(F.col("user_idx").alias("userIdx"), F.col("item_idx").alias("movieIdx"),
                         F.col("label").alias("score")).orderBy("userIdx", "movieIdx")
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).csv(path)


def search_documents(items: DataFrame, tags: DataFrame) -> DataFrame:
    """One document per item (unique on ``mid``) with its tags."""
    t = tags.groupBy("mid").agg(F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("tags"))
    return items.join(t, "mid", "left")


def write_search_documents(docs: DataFrame, path: str) -> None:
    """S10 sink: JSON lines keyed by ``mid`` (a search index would take them as is)."""
    docs.write.mode("overwrite").json(path)


def ratings_json(ratings: DataFrame) -> DataFrame:
    """A user's rating list as JSON, each entry nested as ``{"rating": {...}}``."""
    lst = ratings.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("ts", "mid", "score"))).alias("_r"))
    return lst.select("uid", F.to_json(F.transform("_r", lambda r: F.struct(
        F.struct(r["mid"].alias("mid"), r["score"].alias("score"), r["ts"].alias("timestamp")).alias("rating"))))
        .alias("ratings"))
