"""Dense surrogate indexes and global positions without a one-partition window.

``row_number() over (order by k)`` with no partition moves every row into one
task. Here the rows are range-partitioned on the order (balanced by sampling),
sorted within partitions and checkpointed to the session's reliable
checkpoint folder; the position is then ``offset(partition) + position within
partition``. The only driver-side value is one count per partition (bounded
by the partition count, not by the data).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.session import checkpoint_dir, shuffle_partitions


def _as_cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def global_row_number(df: DataFrame, order: Sequence[str | Column], out: str = "row_idx",
                      partitions: int | None = None) -> DataFrame:
    """Append ``out`` = 0-based position of each row in ``order`` (a total order).

    Equal to ``row_number() over (order by ...) - 1`` but distributed. The
    checkpoint fixes the range bounds and the in-partition order, so a lost
    executor recomputes the same positions.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or shuffle_partitions(spark)
    cols = _as_cols(order)
    ranged = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mono", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    counts = {r["_pid"]: r["n"] for r in
              ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, acc = [], 0
    for pid in range(max(counts, default=-1) + 1):
        offsets.append(acc)
        acc += counts.get(pid, 0)
    offset = F.element_at(F.array(*[F.lit(o).cast("bigint") for o in offsets] or [F.lit(0).cast("bigint")]),
                          F.col("_pid") + 1)
    local = F.col("_mono") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return ranged.withColumn(out, (offset + local).cast("bigint")).drop("_pid", "_mono")


def dense_index(df: DataFrame, key: str, out: str) -> DataFrame:
    """Distinct ``key`` values with a dense 0-based index in key order (F1)."""
    return global_row_number(df.select(key).where(F.col(key).isNotNull()).distinct(), [key], out)


def attach_index(df: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Left join of an index table (unique on ``key``) onto ``df``.

    Not forced to broadcast: an index grows with the users/items; AQE turns the
    join into a broadcast at runtime when the index is small, and splits a hot
    key's partition (skew join) when it is not.
    """
    return df.join(index, key, "left")


def ntile_from_position(pos: Column, total: Column | int, buckets: int) -> Column:
    """``ntile(buckets)`` of a 0-based position among ``total`` rows (SQL semantics)."""
    total = F.lit(total) if isinstance(total, int) else total
    q = F.floor(total / buckets)
    r = total % buckets
    big = r * (q + 1)
    return (F.when(pos < big, F.floor(pos / (q + 1)) + 1)
            .otherwise(F.floor((pos - big) / F.greatest(q, F.lit(1))) + r + 1)).cast("bigint")


def next_user_index(existing: DataFrame, new_users: DataFrame, key: str, index_col: str) -> DataFrame:
    """Append users absent from ``existing`` with indexes ``max + 1, max + 2, ...``.

    Names already present are rejected (anti-join); new ones get consecutive
    indexes in key order after the current maximum.
    """
    fresh = new_users.select(key).distinct().join(existing.select(key), key, "left_anti")
    ranked = global_row_number(fresh, [key], "_pos")
    base = existing.agg(F.coalesce(F.max(index_col), F.lit(-1)).alias("_base"))
    return ranked.select(key, (F.col("_pos") + base.scalar() + 1).cast("bigint").alias(index_col))
