"""Topic source and sink: offsets, replay, restart, two-phase commit."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from reelspark.streaming import job
from reelspark.streaming.topic import Topic, append, partition_of, register, start_topic_filter


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="reelspark-topic-")


def _records(spark, rows):
    return spark.createDataFrame(rows, "key string, value string").repartition(3)


def _all(spark, path):
    return spark.read.format("topic").load(path)


def test_offsets_are_gapless_per_partition_and_keys_stay_together(spark, root):
    append(_records(spark, [(f"k{i % 7}", f"v{i}") for i in range(100)]), f"{root}/t", 4)
    append(_records(spark, [(None, f"w{i}") for i in range(20)] + [("k1", None)]), f"{root}/t", 9)  # the number of partitions stays
    got = _all(spark, f"{root}/t").collect()
    assert sorted(str(r.value) for r in got) == sorted([f"v{i}" for i in range(100)] + [f"w{i}" for i in range(20)] + ["None"])
    by: dict = {}
    for r in got:
        by.setdefault(r.partition, []).append(r.offset)
        assert r.partition == partition_of(r.key, r.value, 4) and r.timestamp > 0
    assert all(sorted(o) == list(range(len(o))) for o in by.values())
    assert Topic(f"{root}/t").ends() == {str(p): len(by.get(p, [])) for p in range(4)}


def test_a_commit_that_failed_is_finished_and_a_replay_appends_nothing(spark, root):
    topic = Topic(f"{root}/t")
    topic.create(2)
    first = [topic.stage([("a", "1", 1), ("a", "2", 1)], 0), topic.stage([("b", "3", 1)], 1)]
    moved = []
    original = topic.fs

    class Failing:
        def __getattr__(self, name):
            return getattr(original, name)

        def move(self, a, b):
            if "partition=" in b and moved:
                raise OSError("lost")
            moved.append(b)
            original.move(a, b)

    topic.fs = Failing()
    moved.clear()
    with pytest.raises(OSError):
        topic.commit("q-0", first)  # the plan is written, and the first move fails
    topic.fs = original
    assert sum(topic.ends().values()) < 3
    again = [topic.stage([("a", "1", 2), ("a", "2", 2)], 0), topic.stage([("b", "3", 2)], 1)]
    topic.commit("q-0", again)  # the same batch once more
    assert topic.ends() == {"0": 2, "1": 1}
    topic.commit("q-0", again)
    assert topic.ends() == {"0": 2, "1": 1} and not topic._files("_staged")
    register(spark)
    assert sorted((r.value, r.timestamp) for r in _all(spark, f"{root}/t").collect()) == [("1", 1), ("2", 1), ("3", 1)]


def test_a_failed_commit_is_finished_by_the_next(root):
    topic = Topic(f"{root}/t")
    topic.create(1)
    a, b = topic.stage([("a", "1", 1)], 0), topic.stage([("a", "2", 1)], 0)
    apply, topic._apply = topic._apply, lambda plan: None
    topic.commit("q-0", [a])
    topic._apply = apply
    assert topic.ends() == {"0": 0}
    topic.commit("q-1", [b])
    assert topic.ends() == {"0": 2}


def _filter(spark, root, starting):
    q = start_topic_filter(spark, f"{root}/log", f"{root}/out", f"{root}/ckpt", starting, {"availableNow": True})
    q.awaitTermination()
    return q


def test_topic_to_topic_restart_and_latest(spark, root):
    line = lambda i: f"INFO x MOVIE_RATING_PREFIX:1|{i}|4.0|{i}" if i % 2 else f"INFO noise {i}"
    append(_records(spark, [(f"u{i % 3}", line(i)) for i in range(30)]), f"{root}/log", 3)
    _filter(spark, root, "earliest")
    values = lambda: sorted(r.value for r in _all(spark, f"{root}/out").collect())
    want = sorted(f"1|{i}|4.0|{i}" for i in range(30) if i % 2)
    assert values() == want
    _filter(spark, root, "earliest")  # nothing new: no offset is read twice
    assert values() == want
    append(_records(spark, [("u1", line(i)) for i in range(30, 40)]), f"{root}/log")
    _filter(spark, root, "earliest")
    assert values() == sorted(f"1|{i}|4.0|{i}" for i in range(40) if i % 2)
    assert {r.key for r in _all(spark, f"{root}/out").collect()} <= {"u0", "u1", "u2"}
    # a new query that starts at the latest offsets sees later records only
    q = (spark.readStream.format("topic").load(f"{root}/out").writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{root}/c2").start())
    q.processAllAvailable()
    append(_records(spark, [("u9", "late")]), f"{root}/out")
    q.processAllAvailable()
    q.stop()
    assert [r.value for r in spark.table("seen").collect()] == ["late"]


def test_rerank_reads_a_topic(spark, root):
    rows = ["x MOVIE_RATING_PREFIX:1|10|4.0|100", "noise", "x MOVIE_RATING_PREFIX:1|11|2.0|101", "x MOVIE_RATING_PREFIX:2|12|5.0|150"]
    append(_records(spark, [(str(i), r) for i, r in enumerate(rows)]), f"{root}/log", 2)
    sims = spark.createDataFrame([(11, 13, 0.9), (13, 11, 0.9), (12, 14, 0.95), (14, 12, 0.95)], "mid long, sim_mid long, score double")
    q = job.start(spark, f"{root}/log", f"{root}/out", f"{root}/ckpt", sims, trigger={"availableNow": True}, fmt="topic", options={"startingOffsets": "earliest"})
    q.awaitTermination()
    assert {(r.uid, r.mid) for r in job.read_lists(spark, f"{root}/out").collect()} == {(1, 13), (2, 14)}
    assert job.current_ratings(spark, f"{root}/ckpt").agg(F.count("*")).first()[0] == 3
