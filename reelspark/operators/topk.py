"""Top-k per group and global top-k reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each group by ``order`` (give a total order).

    ``row_number() <= k`` is planned as WindowGroupLimit: a partial top-k runs
    in every map task before the shuffle, so a hot group ships at most k rows
    per task and the final window sorts at most k x tasks rows per group.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w))
            .where(F.col(rank_col) <= k)
            .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def top_k(df: DataFrame, order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Global top-k report (TakeOrderedAndProject: k rows per task, then merge)."""
    rows = df.orderBy(*order).limit(k)
    # A window over k rows (k is the feature's own small bound) attaches the rank.
    return rows.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
