"""Scoring requests and responses as JSON (S17, Q13, the JSON functions of the serving path).

A request is ``{"test": [{"user_idx": i, "item_idx": j}, ...]}``, its response
``[[score, ...]]`` with a score for each pair, by position. Requests hold at
most REQUEST_PAIRS pairs, so that no array grows with a user's candidates.

A request that is not JSON, or has no list ``test``, has the response null. A
pair without one of the numbers, or whose user or item the model does not
know, has the score null at its place. Candidates and scores are matched by
position up to the shorter list's end; places without a score give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.indexing import global_row_number
from reelspark.operators.scoring import NCFLayers, _forward
from reelspark.session import bound_arrow_batches, checkpoint_dir, shuffle_partitions

REQUEST_PAIRS = 1000
REQUEST_SCHEMA = "struct<test:array<struct<user_idx:bigint,item_idx:bigint>>>"
RESPONSE_SCHEMA = "array<array<double>>"


def segments(rows: DataFrame, key: str, order: list[str], size: int, out: str) -> DataFrame:
    """``rows`` with ``out`` = number of the segment of at most ``size`` rows of
    the same ``key``, in ``order`` (a total order within the key). Positions come
    from one distributed sort, so a key with very many rows costs no task more."""
    placed = global_row_number(rows, [key, *order], "_at")
    first = placed.groupBy(key).agg(F.min("_at").alias("_first"))
    return placed.join(first, key).withColumn(out, F.floor((F.col("_at") - F.col("_first")) / size).cast("bigint")).drop("_first")


def candidate_lists(candidates: DataFrame, size: int = REQUEST_PAIRS) -> DataFrame:
    """The lists of requests of at most ``size`` pairs: (uid, part, mid, item_idx)
    and, if the candidates (uid, mid, item_idx) have it, user_idx, in order of mid.

    Candidates are dealt to ranges of (uid, mid) and packed where they lie, as
    rows and their positions are never written. A task holds one user's rows of
    one range. Users whose rows lie in several ranges, fewer than there are
    ranges, have their rows taken out of the lists again and placed by ``segments``."""
    lists = [c for c in ("mid", "item_idx", "user_idx") if c in candidates.columns]
    kinds = dict(candidates.dtypes)

    def cut(batches):
        for rows in _whole_runs(batches, ["uid"]):
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("uid", "ascending"), ("mid", "ascending")], null_placement="at_start"))
            starts = _starts(rows, ["uid"])
            place = np.arange(rows.num_rows) - np.repeat(starts, np.diff(starts, append=rows.num_rows))
            heads = np.flatnonzero(place % size == 0)
            offsets = pa.array(np.append(heads, rows.num_rows), pa.int32())
            first = rows.take(pa.array(heads))
            yield pa.RecordBatch.from_arrays([first.column("uid"), pa.array(place[heads] // size), *(pa.ListArray.from_arrays(offsets, rows.column(c)) for c in lists)],
                                             names=["uid", "part", *lists])

    spark = candidates.sparkSession
    checkpoint_dir(spark)
    ranged = candidates.select("uid", *lists).where("uid is not null").repartitionByRange(shuffle_partitions(spark), "uid", "mid")
    packed = ranged.sortWithinPartitions("uid").mapInArrow(cut, f"uid {kinds['uid']}, part bigint, " + ", ".join(f"{c} array<{kinds[c]}>" for c in lists))
    made = packed.withColumn("_range", F.spark_partition_id()).checkpoint()
    ranges = made.groupBy("uid").agg(F.min("_range").alias("first"), F.max("_range").alias("last"))
    split = [r["uid"] for r in ranges.where("first < last").collect()]
    made = made.drop("_range")
    if not split:
        return made
    rows = made.where(F.col("uid").isin(split)).select("uid", F.inline(F.arrays_zip(*lists)))
    placed = segments(rows, "uid", ["mid"], size, "part").groupBy("uid", "part").agg(F.array_sort(F.collect_list(F.struct(*lists))).alias("_l"))
    return made.where(~F.col("uid").isin(split)).unionByName(placed.select("uid", "part", *[F.col("_l")[c].alias(c) for c in lists]))


def write_requests(lists: DataFrame) -> DataFrame:
    """(uid, part, mids, request) from lists (uid, part, mid, item_idx) with
    user_idx: a list too, or the number of the user of all pairs."""
    if dict(lists.dtypes)["user_idx"].startswith("array"):
        pairs = F.transform(F.arrays_zip("user_idx", "item_idx"), lambda x: F.struct(x["user_idx"].alias("user_idx"), x["item_idx"].alias("item_idx")))
    else:
        pairs = F.transform("item_idx", lambda x: F.struct(F.col("user_idx"), x.alias("item_idx")))
    return lists.select("uid", "part", F.col("mid").alias("mids"), F.to_json(F.struct(pairs.alias("test"))).alias("request"))


def build_requests(candidates: DataFrame, size: int = REQUEST_PAIRS) -> DataFrame:
    """(uid, part, mids, request) from candidates (uid, mid, user_idx, item_idx), in order of mid."""
    return write_requests(candidate_lists(candidates, size))


def _starts(rows, keys: list[str]) -> np.ndarray:
    """Positions at which the runs of equal ``keys`` begin."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        code = rows.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _whole_runs(batches: Iterator, keys: list[str]) -> Iterator:
    """Batches of rows sorted by ``keys``, dealt anew so that none ends within a run of equal keys."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            batch = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch])
        last = _starts(batch, keys)[-1]
        skip = 1 if held else 0  # the row that stands in ``held`` too
        if last:
            yield pa.concat_batches([*held, batch.slice(skip, last - skip)])
            held = [batch.slice(last)]
        else:
            held.append(batch.slice(skip))
    if held:
        yield pa.concat_batches(held)


def parse_requests(requests: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, user_idx, pairs): a request's pairs (pos, item_idx), one row per user.
    A request without pairs has one row without a user, with one pair without an
    item; its place is -1, or null if the request is malformed."""
    kinds = dict(requests.dtypes)

    def split(batches):
        for batch in batches:
            lists = batch.column("_t")
            n = lists.value_lengths().fill_null(0).to_numpy()
            flat = lists.flatten().flatten()  # (user_idx, item_idx), null where the pair is null
            row = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            user, item = flat
            known = user.is_valid().to_numpy(zero_copy_only=False)
            number = user.fill_null(0).to_numpy()
            differs = lambda: np.flatnonzero(np.r_[len(row) > 0, (row[1:] != row[:-1]) | (number[1:] != number[:-1]) | (known[1:] != known[:-1])])
            starts = differs()
            if len(starts) > np.count_nonzero(n):  # a request of several users
                order = np.lexsort((pos, number, known, row))
                row, pos, number, known, item = row[order], pos[order], number[order], known[order], item.take(pa.array(order))
                starts = differs()
            none = np.flatnonzero(n == 0)
            lone = pa.array(np.full(len(none), -1), pa.int32(), mask=lists.take(pa.array(none)).is_null().to_numpy(zero_copy_only=False))
            offsets = pa.array(np.r_[starts, len(row) + np.arange(len(none) + 1)], pa.int32())
            at = pa.array(np.r_[row[starts], none].astype("int64"))
            users = pa.concat_arrays([pa.array(number[starts], mask=~known[starts]), pa.nulls(len(none), pa.int64())])
            pairs = pa.StructArray.from_arrays([pa.concat_arrays([pa.array(pos, pa.int32()), lone]), pa.concat_arrays([item, pa.nulls(len(none), pa.int64())])], ["pos", "item_idx"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), users, pa.ListArray.from_arrays(offsets, pairs)], names=[*keys, "user_idx", "pairs"])

    parsed = requests.select(*keys, F.from_json("request", REQUEST_SCHEMA)["test"].alias("_t"))
    return parsed.mapInArrow(split, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", user_idx bigint, pairs array<struct<pos:int,item_idx:bigint>>")


def respond(requests: DataFrame, keys: list[str], users: DataFrame, items: DataFrame, layers: NCFLayers) -> DataFrame:
    """(keys, response): every request (unique by ``keys``) scored by the model.
    users (user_idx, u_mlp, u_gmf) are joined once per request and user, items
    (item_idx, i_mlp, i_gmf) to the pairs; none are collected. Every request
    goes along with its pairs, so nothing is parsed or joined again at the end."""
    asked = parse_requests(requests, keys).join(users.select("user_idx", "u_mlp", "u_gmf"), "user_idx", "left")
    pairs = asked.select(*keys, "u_mlp", "u_gmf", F.inline("pairs")).join(items.select("item_idx", "i_mlp", "i_gmf"), "item_idx", "left")
    kinds = dict(requests.dtypes)
    named = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def run(batches):
        vectors = ("u_mlp", "i_mlp", "u_gmf", "i_gmf")
        for batch in batches:
            known = np.logical_and.reduce([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in vectors])
            score = np.full(batch.num_rows, np.nan)
            if known.any():
                some = batch if known.all() else batch.filter(pa.array(known))
                score[known] = _forward(layers, *(some.column(c).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1) for c in vectors))
            starts = _starts(batch, keys)
            offsets = pa.array(np.append(starts, batch.num_rows), pa.int32())
            heads = batch.take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([*(heads.column(c) for c in keys), pa.ListArray.from_arrays(offsets, batch.column("pos")),
                                              pa.ListArray.from_arrays(offsets, pa.array(score, mask=~known))], names=[*keys, "pos", "score"])

    def listed(batches):
        for rows in _whole_runs(batches, ["_hash"]):
            rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in keys]))
            starts = _starts(rows, keys)
            run = np.repeat(np.arange(len(starts)), np.diff(starts, append=rows.num_rows))
            run = np.repeat(run, rows.column("pos").value_lengths().to_numpy())  # of every pair
            pos, score = rows.column("pos").flatten(), rows.column("score").flatten()
            valid = np.zeros(len(starts), dtype=bool)
            valid[run[pos.is_valid().to_numpy(zero_copy_only=False)]] = True
            pos = pos.fill_null(-1).to_numpy()
            order = np.lexsort((pos, run))
            order = order[pos[order] >= 0]
            offsets = np.append(0, np.cumsum(np.bincount(run[order], minlength=len(starts))))
            heads = rows.take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([*(heads.column(c) for c in keys), pa.array(valid), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), score.take(pa.array(order)))],
                                             names=[*keys, "valid", "scores"])

    # Neighbouring pairs of a request go on as one row. Rows are sorted by one number, which is
    # cheaper than by keys; requests of equal hash are told apart in ``listed``.
    bound_arrow_batches(requests.sparkSession)
    scored = pairs.select(*keys, "pos", "u_mlp", "i_mlp", "u_gmf", "i_gmf").mapInArrow(run, f"{named}, pos array<int>, score array<double>")
    lists = scored.repartition(*keys).withColumn("_hash", F.xxhash64(*keys)).sortWithinPartitions("_hash").mapInArrow(listed, f"{named}, valid boolean, scores array<double>")
    return lists.select(*keys, F.when(F.col("valid"), F.to_json(F.array("scores"))).alias("response"))


def read_responses(asked: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mid, score): candidates (``mids``) and scores matched by position."""
    scores = F.get(F.from_json("response", RESPONSE_SCHEMA), F.lit(0))
    zipped = asked.select(*keys, "mids").join(responses, keys).select(*keys, F.posexplode(F.arrays_zip(F.col("mids"), scores.alias("scores"))).alias("pos", "_z"))
    return zipped.select(*keys, F.col("_z.mids").alias("mid"), F.col("_z.scores").alias("score")).where("mid is not null and score is not null")
