"""CSV sources in the MovieLens layout (S1-S5), with explicit schemas.

Every reader declares its schema (no inference pass over the data) and
drops malformed rows in the parser, so filters and column pruning reach
the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATINGS_SCHEMA = "userId string, movieId int, rating double, timestamp bigint"
MOVIES_SCHEMA = "movieId int, title string, genres string"
LINKS_SCHEMA = "movieId int, imdbId string, tmdbId string"
TAGS_SCHEMA = "userId string, movieId int, tag string, timestamp bigint"


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED")
            .option("quote", '"').option("escape", '"').csv(path))


def read_ratings(spark: SparkSession, path: str, uid_prefix: str = "User") -> DataFrame:
    """Ratings with exactly four fields; uid gets the text prefix the
    reference's user table uses. Rows ``uid, mid, score, ts``."""
    df = _csv(spark, path, RATINGS_SCHEMA).where(F.col("movieId").isNotNull() & F.col("rating").isNotNull())
    return df.select(F.concat(F.lit(uid_prefix), F.trim("userId")).alias("uid"), F.col("movieId").alias("mid"),
                     F.col("rating").alias("score"), F.col("timestamp").alias("ts"))


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    """Id, title (commas inside quotes kept, quotes removed), genres."""
    return _csv(spark, path, MOVIES_SCHEMA).where(F.col("movieId").isNotNull()).select(
        F.col("movieId").alias("mid"), F.trim("title").alias("title"), F.trim("genres").alias("genres"))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """S3: ids kept as strings (leading zeros matter)."""
    return _csv(spark, path, LINKS_SCHEMA).where(F.col("movieId").isNotNull()).select(
        F.col("movieId").alias("mid"), "imdbId", "tmdbId")


def read_tags(spark: SparkSession, path: str, uid_prefix: str = "User") -> DataFrame:
    """S4, intended semantics: rows with exactly four fields (quoted commas
    allowed) are tags. Rows ``uid, mid, tag, ts``."""
    df = _csv(spark, path, TAGS_SCHEMA).where(F.col("movieId").isNotNull())
    return df.select(F.concat(F.lit(uid_prefix), F.trim("userId")).alias("uid"), F.col("movieId").alias("mid"),
                     F.trim("tag").alias("tag"), F.col("timestamp").alias("ts"))


def read_header_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV with a declared schema (the reference reads all strings)."""
    return _csv(spark, path, schema)
