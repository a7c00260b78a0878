"""Last-write-wins merge (rating upsert, rec-list upsert)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_write_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    payload: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the payload of the row greatest by ``order``.

    Expressed as ``max(struct(order..., payload...))`` so Spark aggregates
    partially before the shuffle: a key with millions of versions sends one
    row per map task, not all of them. Spark sorts the rows by key for a struct
    maximum; ``newest_by_number`` does without. Ties on the whole ``order``
    tuple resolve on the payload, deterministically.
    """
    fields = list(order) + [p for p in payload if p not in order]
    w = F.max(F.struct(*[F.col(c) for c in fields])).alias("_w")
    out = df.groupBy(*keys).agg(w)
    return out.select(*keys, *[F.col("_w")[p].alias(p) for p in payload])


def newest_by_number(df: DataFrame, keys: Sequence[str], number: Column, payload: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the payload of the row with the largest ``number``.

    With a number (bigint or decimal, unique within a key) and fixed-width
    payload columns the aggregation is hashed: nothing is sorted before or
    after the shuffle, where a struct order needs a sort on both sides.
    """
    n = df.withColumn("_number", number)
    return n.groupBy(*keys).agg(*[F.max_by(p, "_number").alias(p) for p in payload])


def merge_latest(base: DataFrame, changes: DataFrame, keys: Sequence[str],
                 order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Upsert ``changes`` into ``base``: the newest version per key wins.

    Replaying the same change set leaves the result unchanged (idempotent).
    """
    cols = list(dict.fromkeys([*keys, *order, *payload]))
    return last_write_wins(base.select(*cols).unionByName(changes.select(*cols)),
                           keys, order, [c for c in cols if c not in keys])
