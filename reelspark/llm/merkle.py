"""Merkle manifest of a table by time-forward processing.

Every row is a leaf; the leaves of a group (``lang``) ascend by doc_id and form
a binary tree whose root is the group's subroot; the subroots, in group order,
form one more tree whose root names the whole table.

Nodes are labelled (last leaf below, level), an order in which children come
before their parent. The upward sweep takes the nodes by label; each sends its
digest to the label of its parent through a priority queue, so that a parent
finds its children's digests at the head of the queue when its turn comes. The
downward sweep takes the labels backwards; each node sends its proof suffix,
lengthened by the child's sibling, to its children, and what reaches a leaf is
its proof. In this order a queue never holds more than two messages a level.

A sweep runs in slices of ``LEVELS`` levels: a task holds one aligned block of
at most 2^LEVELS nodes of a tree. Messages that leave a block go on through
Spark's shuffle, which sorts and spills (the external part of the queue) and
deals them to the next slice, one row per block. So a table of n rows takes
log(n) / LEVELS slices, and no task sees more than one block however large a
group is. Texts are read once, in the scan that hashes them, and never move.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspark.llm.common import broadcast_if, prepare
from reelspark.operators.indexing import global_row_number

#: Levels of one slice; a block has up to 2^LEVELS nodes.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])
_STEPS = "array<struct<before string, after string>>"
_NODES = "tree bigint, total bigint, pos bigint, digest binary"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields in order."""
    return F.sha2(F.concat(*map(field, values)), 256)


def _hash(*hexes: str) -> str:
    return sha256("".join(hexes).encode()).hexdigest()


def sweep_up(first: int, digests: Sequence[str], levels: int) -> list[dict[int, str]]:
    """Digests of the nodes above leaves first, first + 1, ..., per level by index.

    ``first`` is a multiple of 2^levels and there are at most 2^levels leaves.
    The last node of a level may be the only child of its parent.
    """
    last = first + len(digests) - 1
    nodes: list[dict[int, str]] = [{} for _ in range(levels + 1)]
    queue: list[tuple[int, int, int, int, str]] = []  # end, level, index of the receiver; child, digest

    def send(level: int, index: int, digest: str) -> None:
        nodes[level][index] = digest
        if level < levels:
            parent = index >> 1
            end = min((parent + 1 << level + 1) - 1, last)
            heapq.heappush(queue, (end, level + 1, parent, index, digest))

    for pos, digest in enumerate(digests, first):
        send(0, pos, digest)
        while queue and queue[0][0] <= pos:
            _, level, index, _, got = heapq.heappop(queue)
            parts = [got]
            while queue and queue[0][1:3] == (level, index):
                parts.append(heapq.heappop(queue)[4])
            send(level, index, _hash(*parts))
    return nodes


def sweep_down(nodes: list[dict[int, str]], suffix: tuple) -> dict[int, tuple]:
    """Per leaf the steps (digests before, digests after) up to the root; ``suffix`` are those above the top node."""
    top = len(nodes) - 1
    last = max(nodes[0])
    proofs: dict[int, tuple] = {}
    queue = [(0, -top, next(iter(nodes[top])), suffix)]  # -end, -level, index of the receiver; its suffix
    while queue:
        _, level, index, steps = heapq.heappop(queue)
        level = -level
        if level == 0:
            proofs[index] = steps
            continue
        below = nodes[level - 1]
        left, right = 2 * index, 2 * index + 1
        for child, step in ((left, ("", below.get(right, ""))), (right, (below[left], ""))):
            if child in below:
                end = min((child + 1 << level - 1) - 1, last)
                heapq.heappush(queue, (-end, 1 - level, child, (step, *steps)))
    return proofs


def _block(table: pa.Table, most: int) -> tuple[pa.Table, int, list[dict[int, str]]]:
    """The block in order, its number of levels (at most ``most``) and its nodes."""
    table = table.sort_by("pos")
    levels = min(most, (table.column("total")[0].as_py() - 1).bit_length())
    return table, levels, sweep_up(table.column("pos")[0].as_py(), [d.hex() for d in table.column("digest").to_pylist()], levels)


def _up(most: int):
    """Nodes of a block -> the block's top node, a leaf of the next slice."""
    def run(table: pa.Table) -> pa.Table:
        table, levels, nodes = _block(table, most)
        (index, digest), = nodes[levels].items()
        total = -(-table.column("total")[0].as_py() >> levels)
        return pa.table({"tree": table.column("tree").slice(0, 1), "total": pa.array([total]), "pos": pa.array([index]),
                         "digest": pa.array([bytes.fromhex(digest)], pa.binary())})
    return run


def _down(most: int, columns: list[str]):
    """Nodes of a block and its one suffix row -> those nodes with their steps."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        table, _, nodes = _block(left, most)
        suffix = tuple((s["before"], s["after"]) for s in right.column("steps")[0].as_py())
        proofs = sweep_down(nodes, suffix)
        steps = [proofs[p] for p in table.column("pos").to_pylist()]
        flat = [s for x in steps for s in x]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in steps])]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array([s[i] for s in flat], pa.string()) for i in (0, 1)], fields=list(_STEP))
        same = lambda name: pa.array([right.column(name)[0].as_py()] * len(steps), pa.string())
        return table.select(columns).append_column("subroot", same("subroot")).append_column("steps", pa.ListArray.from_arrays(pa.array(offsets), values))
    return run


def climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Nodes (tree, total, pos, digest) at levels 0, LEVELS, 2 * LEVELS, ... until each tree has one; ``most`` is the largest total."""
    slices = [nodes]
    while most > 1:
        blocks = slices[-1].select("tree", "total", "pos", "digest", F.shiftright("pos", LEVELS).alias("block"))
        slices.append(blocks.groupBy("tree", "block").applyInArrow(_up(LEVELS), _NODES).checkpoint())
        most = -(-most >> LEVELS)
    return slices


def descend(slices: list[DataFrame], suffix: DataFrame) -> DataFrame:
    """The nodes of ``slices[0]`` with subroot and steps; ``suffix`` holds (tree, pos, subroot, steps) of the trees' tops."""
    for nodes in reversed(slices[:-1]):
        kept = [(n, t) for n, t in nodes.dtypes if n not in ("total", "digest")] if nodes is slices[0] else [("tree", "bigint"), ("pos", "bigint")]
        schema = ", ".join(f"{n} {t}" for n, t in kept) + f", subroot string, steps {_STEPS}"
        suffix = (nodes.withColumn("block", F.shiftright("pos", LEVELS)).groupBy("tree", "block")
                  .cogroup(suffix.withColumnRenamed("pos", "block").groupBy("tree", "block"))
                  .applyInArrow(_down(LEVELS, [n for n, _ in kept]), schema))
    return suffix


def _numbered(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """Leaves with tree (number of the group), total (its leaves) and pos (from 0); the largest total; the number of trees.

    Positions come from a range-partitioned sort; rows equal in all columns may
    change places with each other. A summary row per (partition, group) is all
    that is numbered further."""
    order = ["lang", "doc_id", "digest", "__reel_m"]
    cut = (leaves.withColumn("__reel_m", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("__reel_m")
           .withColumn("part", F.spark_partition_id()).withColumn("at", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))).checkpoint())
    parts = cut.groupBy("part", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo")).checkpoint()
    trees = global_row_number(parts.groupBy("lang").agg(F.sum("n").alias("total")), ["lang"], "tree").checkpoint()
    most, groups = trees.agg(F.max("total"), F.count(F.lit(1))).first()
    g = broadcast_if(trees.withColumnRenamed("lang", "__reel_lang"), groups)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = (parts.withColumn("start", before - F.col("lo")).join(g, F.col("lang").eqNullSafe(F.col("__reel_lang")))
              .select(F.col("part").alias("__reel_part"), "__reel_lang", "start", "tree", "total").checkpoint())
    s = broadcast_if(starts, starts.count())
    numbered = (cut.join(s, (F.col("part") == F.col("__reel_part")) & F.col("lang").eqNullSafe(F.col("__reel_lang")))
                .withColumn("pos", F.col("at") + F.col("start")).drop("part", "at", "start", "__reel_part", "__reel_lang"))
    return numbered, most or 0, groups


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """lang, doc_id, leaf, position (in its lang, from 0), subroot, root and
    steps, one row per row of ``docs``; ``carry`` adds small columns computed
    from the row.

    steps are the proof from the leaf up: per level the sibling's digest before
    or after the own one, both empty where the node is alone. ``fold`` gives
    the root from a leaf and its steps.

    A null in any column is the field ``-``; null langs form the first group and
    null doc_ids come first in theirs. Rows of equal doc_id are ordered by leaf;
    rows equal in every field share a leaf, and which of their places belongs
    to which is not told apart. Empty and very long texts are hashed whole.
    Other columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    prepare(docs.sparkSession)
    spark, carry = docs.sparkSession, carry or {}
    leaves = docs.select("lang", "doc_id", F.unhex(leaf_digest(*map(F.col, FIELDS))).alias("digest"), *[c.alias("c_" + n) for n, c in carry.items()])
    numbered, most, groups = _numbered(leaves.checkpoint())  # the sort samples its input first: texts are read once all the same
    slices = climb(numbered.withColumn("leaf", F.lower(F.hex("digest"))), most)
    subroots = slices[-1].select("tree", "digest").checkpoint()
    tops = climb(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.lit(groups).cast("bigint").alias("total"), F.col("tree").alias("pos"), "digest"), groups)
    root = tops[-1].select(F.lower(F.hex("digest"))).first()
    if root is None:
        return docs.select("lang", "doc_id", F.lit("").alias("leaf"), F.lit(0).cast("bigint").alias("position"), F.lit("").alias("subroot"),
                           F.lit("").alias("root"), F.lit(None).cast(_STEPS).alias("steps"), *[c.alias(n) for n, c in carry.items()]).where("false")
    one = spark.createDataFrame([(0, 0, "", [])], f"tree bigint, pos bigint, subroot string, steps {_STEPS}")
    above = descend(tops, one).select(F.col("pos").alias("tree"), "steps")
    suffix = (subroots.join(above, "tree")
              .select("tree", F.lit(0).cast("bigint").alias("pos"), F.lower(F.hex("digest")).alias("subroot"), "steps"))
    if len(slices) == 1:  # every group has one row
        rows = slices[0].join(suffix.drop("pos"), "tree")
    else:
        rows = descend(slices, suffix.checkpoint())
    return rows.select("lang", "doc_id", "leaf", F.col("pos").alias("position"), "subroot", F.lit(root[0]).alias("root"), "steps",
                       *[F.col("c_" + n).alias(n) for n in carry])


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each
    document's proof, checked against the table after tampering. Where 7
    divides the CRC-32 of the decimal doc_id, n_chars is one more than in the
    manifest (nulls stay); rows without a doc_id are left as they are."""
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0,
                     F.unhex(leaf_digest(*[more if c == "n_chars" else F.col(c) for c in FIELDS])))
    rows = manifest(docs, {"tampered": changed})
    given = F.coalesce(F.lower(F.hex("tampered")), F.col("leaf"))
    joined = F.concat_ws("", F.transform("steps", lambda s: F.concat(s["before"], s["after"])))
    return (rows.withColumn("folded_root", fold(given, F.col("steps")))
            .select("doc_id", "leaf", "subroot", "root", F.sha2(joined, 256).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))
