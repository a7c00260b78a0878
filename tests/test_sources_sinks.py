"""CSV sources and table sinks on tiny files."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import functions as F

from reelspark.sources import movielens, sinks


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_movielens_csv_readers(spark):
    d = tempfile.mkdtemp(prefix="reelspark-csv-")
    _write(f"{d}/ratings.csv", "userId,movieId,rating,timestamp\n1,31,2.5,1260759144\n1,oops,3,1\n2,10,4.0,1\n3,5\n")
    _write(f"{d}/movies.csv", 'movieId,title,genres\n1,Toy Story (1995),Adventure|Animation\n'
                              '11,"American President, The (1995)",Comedy|Drama|Romance\n')
    _write(f"{d}/links.csv", "movieId,imdbId,tmdbId\n1,0114709,862\n")
    _write(f"{d}/tags.csv", 'userId,movieId,tag,timestamp\n15,339,"sandra, boring",1138537770\n15,1955,dentist,1193435061\n')
    r = sorted(map(tuple, movielens.read_ratings(spark, f"{d}/ratings.csv").collect()))
    assert r == [("User1", 31, 2.5, 1260759144), ("User2", 10, 4.0, 1)]
    m = {x["mid"]: x["title"] for x in movielens.read_movies(spark, f"{d}/movies.csv").collect()}
    assert m[11] == "American President, The (1995)"
    assert movielens.read_links(spark, f"{d}/links.csv").first()["imdbId"] == "0114709"
    t = movielens.read_tags(spark, f"{d}/tags.csv").collect()
    assert {x["tag"] for x in t} == {"sandra, boring", "dentist"}


def test_sinks_round_trip(spark):
    d = tempfile.mkdtemp(prefix="reelspark-sink-")
    df = spark.createDataFrame([(3, 1, 1), (1, 2, 0), (2, 3, 1)], "user_idx long, item_idx long, label int")
    sinks.write_table(df, f"{d}/t", key="user_idx", partitions=2)
    assert sorted(map(tuple, spark.read.parquet(f"{d}/t").collect())) == sorted(map(tuple, df.collect()))
    sinks.export_samples_csv(df, f"{d}/csv", single_file=True)
    files = [f for f in os.listdir(f"{d}/csv") if f.endswith(".csv")]
    assert len(files) == 1
    lines = open(f"{d}/csv/{files[0]}").read().split()
    assert lines[0] == "userIdx,movieIdx,score" and lines[1].startswith("1,")
    items = spark.createDataFrame([(1, "a", "X")], "mid long, title string, genres string")
    tags = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b")], "mid long, tag string")
    doc = sinks.search_documents(items, tags).first()
    assert doc["tags"] == "a|b"
    rj = sinks.ratings_json(spark.createDataFrame([(1, 5, 4.5, 10)], "uid long, mid long, score double, ts long"))
    assert json.loads(rj.first()["ratings"]) == [{"rating": {"mid": 5, "score": 4.5, "timestamp": 10}}]
    assert rj.select(F.col("uid")).first()[0] == 1
