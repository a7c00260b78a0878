"""Streaming: state step, replay equality whatever the batches, restart, state as read back."""

from __future__ import annotations

import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelspark.operators.topk import top_k_per_group
from reelspark.operators.upsert import last_write_wins
from reelspark.plans.q_stream import _events, _sims
from reelspark.sources import driver_tables as src
from reelspark.streaming import job
from reelspark.streaming import rerank as rr


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_recent_list_does_not_depend_on_order_or_chunks(seed):
    rnd = random.Random(seed)
    rows = [(1, i % 30, 1.0, i) for i in range(45)]
    rnd.shuffle(rows)
    kept, rated = [], {}
    while rows:  # several micro-batches of several Arrow batches
        batch, rows = rows[:17], rows[17:]
        pdfs = [pd.DataFrame(batch[i:i + 5], columns=["uid", "mid", "score", "ts"]) for i in range(0, len(batch), 5)]
        for kept, some in job.newest_events(kept, iter(pdfs)):
            rated = {m: max(rated.get(m, v), v) for m, v in {**rated, **some}.items()} | {m: max(rated.get(m, v), v) for m, v in some.items()}
    assert [m for _, m, _ in kept] == [(44 - i) % 30 for i in range(40)]  # newest first, repeats kept
    assert rated == {m: (m + 30 if m < 15 else m, 1.0) for m in range(30)}


def _run(spark, root, sims, files, **kw):
    q = job.start(spark, f"{root}/source", f"{root}/out", f"{root}/ckpt", sims,
                  trigger={"availableNow": True}, files_per_trigger=files, **kw)
    q.awaitTermination()
    return q


def _lists(spark, root):
    return sorted(map(tuple, job.read_lists(spark, f"{root}/out").select("uid", "rank", "mid", F.round("score", 9)).collect()))


@pytest.mark.parametrize("order,records,per_trigger", [("forward", 10_000, 8), ("reversed", 50, 3), ("shuffled", 50, 2)])
def test_stream_equals_batch_replay(spark, sf_dir, order, records, per_trigger):
    sims = _sims(spark, sf_dir)
    want = sorted(map(tuple, rr.rerank_batch(_events(spark, sf_dir), sims)
                      .select("uid", "rank", "mid", F.round("score", 9)).collect()))
    root = tempfile.mkdtemp(prefix="reelspark-stream-")
    lines = src.log_lines(spark, sf_dir)
    keys = {"forward": F.col("event_id"), "reversed": F.col("event_id").desc(), "shuffled": F.xxhash64("event_id")}
    (lines.repartitionByRange(8, keys[order]).sortWithinPartitions(keys[order])
     .select(F.col("line").alias("value")).write.text(f"{root}/source"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        _run(spark, root, sims, per_trigger)
        assert _lists(spark, root) == want
        # restart from the same checkpoint: nothing new to read, lists unchanged
        again = _run(spark, root, sims, per_trigger)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(p["numInputRows"] == 0 for p in again.recentProgress)
    assert _lists(spark, root) == want
    latest = last_write_wins(_events(spark, sf_dir), ["uid", "mid"], list(rr.EVENT_ORDER), ["score", "ts"]).select("uid", "mid", "score", "ts")
    assert sorted(map(tuple, job.current_ratings(spark, f"{root}/ckpt").collect())) == sorted(map(tuple, latest.collect()))
    kept = sorted((r.uid, -r.ts, -r.mid, -r.score) for r in job.recent_lists(spark, f"{root}/ckpt").collect())
    newest = top_k_per_group(_events(spark, sf_dir).select("uid", "mid", "score", "ts"), ["uid"], [F.col(c).desc() for c in rr.EVENT_ORDER], rr.RECENT_LIST_CAP)
    assert kept == sorted((r.uid, -r.ts, -r.mid, -r.score) for r in newest.collect())


def _small_stream(spark):
    root = tempfile.mkdtemp(prefix="reelspark-compact-")
    rows = ["x MOVIE_RATING_PREFIX:1|10|4.0|100", "x MOVIE_RATING_PREFIX:1|11|2.0|101", "noise",
            "x MOVIE_RATING_PREFIX:1|10|1.5|200", "x MOVIE_RATING_PREFIX:2|12|5.0|150"]
    spark.createDataFrame([(r,) for r in rows], "value string").repartition(5).write.text(f"{root}/source")
    sims = spark.createDataFrame([(10, 13, 0.9), (11, 13, 0.8), (12, 14, 0.95), (13, 10, 0.9), (14, 12, 0.95)],
                                 "mid long, sim_mid long, score double")
    base = spark.createDataFrame([(3, 10, 2.0, 5), (1, 15, 1.0, 7)], job.EVENT_SCHEMA)
    _run(spark, root, sims, 2, base_ratings=base)
    return root


def test_base_ratings_and_state(spark):
    root = _small_stream(spark)
    want = [(1, 10, 1.5, 200), (1, 11, 2.0, 101), (1, 15, 1.0, 7), (2, 12, 5.0, 150), (3, 10, 2.0, 5)]
    assert sorted(map(tuple, job.current_ratings(spark, f"{root}/ckpt").collect())) == want
    assert sorted((r.uid, r.ts) for r in job.recent_lists(spark, f"{root}/ckpt").collect()) == [(1, 100), (1, 101), (1, 200), (2, 150)]
    lists = {(r["uid"], r["mid"]) for r in job.read_lists(spark, f"{root}/out").collect()}
    # user 1's newest event is (10, 1.5): candidate 13; user 2's is (12): candidate 14; user 3 has no event
    assert (1, 13) in lists and (2, 14) in lists and all(u != 3 for u, _ in lists)


def test_a_batch_that_runs_again_overwrites_its_version(spark):
    """foreachBatch may see a batch twice after a failure: the lists stay as they were."""
    root = tempfile.mkdtemp(prefix="reelspark-again-")
    job.init_output(spark, root)
    sims = spark.createDataFrame([(10, 13, 0.9), (13, 10, 0.9)], "mid long, sim_mid long, score double")
    batch = spark.createDataFrame([(1, 10, [(10, 4.0)]), (1, 10, []), (2, 13, [(13, 1.0)]), (2, 13, [])], job.STATE_OUT_SCHEMA)
    run = job.upsert_batch(root, sims)
    run(batch, 0)
    first = sorted(map(tuple, job.read_lists(spark, root).collect()))
    run(batch, 0)
    assert sorted(map(tuple, job.read_lists(spark, root).collect())) == first and {r[0] for r in first} == {1, 2}


def test_candidates_with_large_groups_and_many_seen(spark):
    """Members of equal vectors: only as many are read as can be chosen."""
    from reelspark.operators.similarity import GroupedPairs
    members = spark.createDataFrame([(i, 0) for i in range(200)] + [(500, 500), (501, 500)], "mid long, _rep long")
    pairs = spark.createDataFrame([(0, 0, 1.0), (500, 500, 1.0), (0, 500, 0.8), (500, 0, 0.8)], "_a long, _b long, score double")
    last = spark.createDataFrame([(1, 3), (2, 500)], "uid long, mid long")
    seen = spark.createDataFrame([(1, i) for i in range(0, 60)] + [(2, 500)], "uid long, mid long")
    got = sorted((r.uid, r["rank"], r.mid) for r in rr.candidates(last, seen, GroupedPairs(members, pairs)).collect())
    assert got == [(1, i + 1, 60 + i) for i in range(10)] + [(2, 1, 501)] + [(2, i + 2, i) for i in range(9)]


def test_the_log_is_parsed_once(spark, sf_dir):
    """A message is split once per row, and the fallback lists read the log once."""
    from reelspark.plans.q_stream import _fallback_lists
    optimized = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    plan = optimized(_events(spark, sf_dir).select("uid", "mid", "score", "ts"))
    assert plan.count("split(") == 1
    assert "event_type" in plan and "event_type" not in optimized(_fallback_lists(spark, sf_dir))


def test_message_fields(spark):
    """Bad rows go; a message ends at a second prefix; other columns stay."""
    p = "MOVIE_RATING_PREFIX:"
    lines = [f"x {p}1|2|3.5|4", f"{p} 1 | 2 | NaN | 4 {p}9|9|9|9", f"{p}1|2|3", f"{p}1|2|3|4|5", f"{p}a|2|3|4", f"{p}1||3|4", p, "1|2|3|4", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "n int, line string")
    got = rr.parse_messages(rr.filter_log(df)).orderBy("n").collect()
    assert [(r.n, r.message, r.uid, r.mid, str(r.score), r.ts) for r in got] == [(0, "1|2|3.5|4", 1, 2, "3.5", 4), (1, "1 | 2 | NaN | 4", 1, 2, "nan", 4)]


class _Map(dict):
    """A map state that counts its lookups."""
    lookups = 0

    def containsKey(self, k):
        self.lookups += 1
        return k in self

    def getValue(self, k):
        self.lookups += 1
        return self[k]

    def updateValue(self, k, v):
        self[k] = v

    def iterator(self):
        return iter(list(self.items()))


class _List(list):
    def get(self):
        return iter(list(self))

    def put(self, rows):
        self[:] = rows


@pytest.mark.parametrize("most", [10_000, 3])
def test_state_of_a_user_is_read_at_once(monkeypatch, most):
    """Rated items are not looked up one by one unless there are very many; both ways give the same state and rows."""
    monkeypatch.setattr(job, "CHUNK", most)
    state = job.UserState()
    state._rated, state._recent = _Map({(5,): (9, 1.0)}), _List()
    events = [(i % 7, float(i % 5), i) for i in range(20)]
    for at in (0, 8):
        pdfs = [pd.DataFrame(events[a:a + 4], columns=["mid", "score", "ts"]) for a in range(at, (8, 20)[at > 0], 4)]
        out = pd.concat(list(state.handleInputRows((1,), iter(pdfs), None)))
    assert {k[0]: v for k, v in state._rated.items()} == {m: max((t, s) for i, s, t in events if i == m) for m in range(7)}
    assert [tuple(r)[0] for r in state._recent] == list(range(19, -1, -1))
    sizes = out["recent"].map(len).tolist()
    assert sizes == [20] + [0] * 7 and out["mid"].tolist()[0] == 5 and sorted(out["mid"].tolist()[1:]) == list(range(7)) and set(out["uid"]) == {1}
    assert (state._rated.lookups == 0) == (most > 7)
