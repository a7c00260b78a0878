"""Per-key positions and sliding row frames, the same way for every key.

``Window.partitionBy(key).orderBy(...)`` sorts every row of a key in one task,
and a key may hold a third of all rows. Here one distributed sort
(``indexing.global_row_number``: range partitions cut through large keys)
positions all rows; a key's positions are cut into chunks of ``chunk_rows``,
the last ``width`` rows of each chunk are copied into the next one as context,
and the frame runs per (key, chunk). Every task sorts at most
``chunk_rows + width`` rows of a key, and the result is exactly the plain
window's, whatever ``chunk_rows`` is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.operators.indexing import global_row_number

#: Rows of a key that one task frames at a time; results do not depend on it.
CHUNK_ROWS = 100_000


def key_positions(df: DataFrame, key: str, order: Sequence[str], out: str = "pos") -> DataFrame:
    """``row_number() over (partition by key order by ...) - 1`` as bigint."""
    pos = global_row_number(df, [key, *order], "_g")
    start = pos.groupBy(F.col(key).alias("_of")).agg(F.min("_g").alias("_g0"))
    return (pos.join(start, pos[key].eqNullSafe(start["_of"]))
            .withColumn(out, F.col("_g") - F.col("_g0")).drop("_g", "_g0", "_of"))


def sliding_frame(df: DataFrame, key: str, order: Sequence[str], width: int,
                  make_cols: Callable[[Window], list[Column]],
                  chunk_rows: int = CHUNK_ROWS, position: str = "_p") -> DataFrame:
    """``df`` plus ``position`` (0-based, within the key) and the columns of
    ``make_cols(w)``, ``w = partitionBy(key, chunk).orderBy(position)``: frames
    that reach at most ``width`` rows back see the same rows as in
    ``partitionBy(key).orderBy(*order)``.

    ``order`` must be a total order within a key.
    """
    if chunk_rows < width:
        raise ValueError("chunk_rows must be >= width")
    pos = key_positions(df, key, order, position).withColumn("_c", F.floor(F.col(position) / chunk_rows).cast("bigint"))
    # a row near the end of its chunk is dealt to the next one too, as context
    copies = F.when(F.col(position) % chunk_rows >= chunk_rows - width, F.array(F.col("_c"), F.col("_c") + 1)).otherwise(F.array(F.col("_c")))
    dealt = pos.withColumn("_in", F.explode(copies))
    w = Window.partitionBy(key, "_in").orderBy(position)
    return dealt.select("*", *make_cols(w)).where(F.col("_in") == F.col("_c")).drop("_c", "_in")
