"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import gathered


def _least_neighbour(directed: DataFrame) -> DataFrame:
    """Per u the least of u and its neighbours."""
    return directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _pairs(edges: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """For every row, one (u, v) per pair of columns."""
    return edges.select(F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends])))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _pairs(edges, ("u", "v"), ("v", "u"))
    return both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _pairs(down.join(_least_neighbour(down), "u"), ("v", "m"), ("u", "m")).where("u <> v").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one neighbour below it, and none that has is itself below another."""
    seen = edges.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("below")),
                                         F.struct(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("below")))))
    return seen.groupBy("id").agg(F.sum("out").alias("out"), F.max("below").alias("below")).where("out > 1 or (out = 1 and below = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links over bigint nodes -> (node, component), component being the
    least node reachable. Nodes without a link to another node have no row.

    A star centre never gathers its neighbours: each step is a minimum per node
    (combined map-side) and a join that adaptive execution can split.
    """
    edges = (edges.select(F.greatest("u", "v").cast("bigint").alias("u"), F.least("u", "v").cast("bigint").alias("v"))
             .where("u <> v").distinct().checkpoint())
    rows = edges.count()  # a step at most doubles the links
    while not _is_stars(edges):
        edges = gathered(_small_star(gathered(_large_star(edges), rows).checkpoint()), rows).checkpoint()
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return gathered(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()), rows).checkpoint()
