"""Recommender views derived from the driver's parquet tables.

The driver ships TPC-H-like tables; the recommender jobs need ratings, items,
users, tags and application log lines. Each view below is a pure DataFrame
plan over the parquet scan, so Catalyst prunes columns and pushes filters
into the reader. Mapping (also written as SQL in ``plans/oracle.py``):

* ratings(uid, mid, score, ts): a customer's line items are ratings of parts;
  score = ceil(quantity / 5) / 2 in 0.5..5.0; ts = order date; the newest
  version of each (uid, mid) wins (rating upsert).
* items(mid, title "name (YYYY)", genres "TYPE|word|word") from part.
* users(uid, username) from customer.
* tags(uid, mid, tag, ts) from events.
* log_lines(event_id, line): purchases and views carry a rating message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions.columns import RATING_LOG_PREFIX, epoch_col
from reelspark.operators.upsert import newest_by_number

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    events = (li.join(od, li.l_orderkey == od.o_orderkey)
              .select(F.col("o_custkey").alias("uid"), F.col("l_partkey").alias("mid"),
                      "o_orderdate", "l_orderkey", "l_linenumber", "l_quantity"))
    # date, order, line and quantity as one number of 6 + 19 + 7 + 5 digits, which is compared without a sort
    part = lambda c, shift: c.cast("decimal(38,0)") * F.lit(str(10 ** shift)).cast("decimal(38,0)")
    version = (part(F.unix_date(F.col("o_orderdate").cast("date")) + 100_000, 31) + part(F.col("l_orderkey"), 12)
               + part(F.col("l_linenumber"), 5) + F.round(F.col("l_quantity") * 100).cast("decimal(38,0)"))
    latest = newest_by_number(events, ["uid", "mid"], version.cast("decimal(38,0)"), ["o_orderdate", "l_quantity"])
    return latest.select(
        "uid", "mid",
        (F.ceil(F.col("l_quantity") / 5).cast("double") / 2).alias("score"),
        epoch_col(latest, "o_orderdate").alias("ts"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("mid"),
        F.concat(F.col("p_name"), F.lit(" ("), (F.lit(1970) + F.col("p_size")).cast("string"),
                 F.lit(")")).alias("title"),
        F.concat(F.col("p_type"), F.lit("|"), F.regexp_replace("p_name", " ", "|")).alias("genres"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"),
                                                   F.col("c_name").alias("username"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("uid"),
                    F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("mid"),
                    F.col("event_type").alias("tag"),
                    epoch_col(e, "ts").alias("ts"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    msg = F.concat_ws(
        "|", F.col("user_id").cast("string"), F.regexp_extract("props", "([0-9]+)", 1),
        ((F.lit(1) + F.col("event_id") % 10).cast("double") / 2).cast("string"),
        epoch_col(e, "ts").cast("string"))
    line = (F.when(F.col("event_type").isin("purchase", "view"),
                   F.concat(F.lit("INFO web : " + RATING_LOG_PREFIX), msg))
            .otherwise(F.concat(F.lit("INFO web : "), F.col("event_type"))))
    return e.select("event_id", line.alias("line"))
