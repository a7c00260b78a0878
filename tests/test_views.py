"""The recommender views reproduce the facts the fixtures were designed around."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reelspark.functions.columns import RATING_LOG_PREFIX
from reelspark.sources import driver_tables as src

FACTS = {
    # sf: (ratings, users, items, ratings > 3.5, log lines, lines with the prefix)
    "/root/testdata/sf0.001": (5382, 150, 200, 1623, 1000, 390),
    "/root/testdata/sf0.01": (59391, 1500, 2000, 17622, 10000, 3963),
}


@pytest.mark.parametrize("sf", sorted(FACTS))
def test_view_facts(spark, sf):
    n, users, items, liked, lines, prefixed = FACTS[sf]
    r = src.ratings(spark, sf)
    row = r.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("u"),
                F.countDistinct("mid").alias("m"), F.count_if(F.col("score") > 3.5).alias("liked"),
                F.countDistinct("uid", "mid").alias("keys")).first()
    assert (row["n"], row["u"], row["m"], row["liked"]) == (n, users, items, liked)
    assert row["keys"] == n  # (uid, mid) is unique after the upsert
    ll = src.log_lines(spark, sf)
    assert ll.count() == lines
    assert ll.where(F.col("line").contains(RATING_LOG_PREFIX)).count() == prefixed


def test_scores_and_genres(spark, sf_dir):
    r = src.ratings(spark, sf_dir)
    assert sorted(x[0] for x in r.select("score").distinct().collect()) == [i / 2 for i in range(1, 11)]
    g = src.items(spark, sf_dir).select(F.explode(F.split("genres", r"\|")).alias("g"))
    types = {x[0] for x in src.table(spark, sf_dir, "part").select("p_type").distinct().collect()}
    assert types <= {x[0] for x in g.distinct().collect()}
