"""Query catalogue: ``key -> (spark builder, DuckDB oracle SQL or None)``.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables. Outputs are flat rows (a rank column instead of nested
arrays), integers as bigint and doubles rounded to 6 places, so the oracle
compares them by value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


def query(key: str, covers: str, oracle: str | None = None):
    def deco(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Query(key, fn, oracle, covers)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from reelspark.plans import (  # noqa: F401
        q_stats, q_features, q_similarity, q_models, q_serving, q_stream)
    return REGISTRY
