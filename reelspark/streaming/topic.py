"""A topic as a Spark data source (S11, S12): keyed records in partitions with offsets.

A topic is a folder that all nodes reach (a mounted path, or any URI Arrow's
file systems open). ``partition=P`` holds segments, files of records named by
the offset of their first record and their number, so that a listing tells
all offsets. Records have a key and a value (strings), a timestamp in
milliseconds, and once committed a partition and an offset in it.

``spark.readStream.format("topic")`` reads from the offsets of its checkpoint;
a query without one starts at ``startingOffsets`` (``latest``, as the
reference's consumer, or ``earliest``). ``spark.read.format("topic")`` reads
all. Writing commits in two phases: tasks write segments that no reader sees
and name them in their commit messages; the commit writes one plan that gives
every segment its offsets, and then moves the segments to their places. A
batch that is committed again, after a failure at any point, finds its plan and
finishes it; what its second run wrote is dropped. So no record is appended
twice. One query writes to a topic at a time (``writer`` tells queries apart).
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter,
                                    DataSourceWriter, InputPartition, WriterCommitMessage)

from reelspark.session import ship_package
from reelspark.streaming.rerank import filter_log

SCHEMA = "key string, value string, partition int, offset bigint, timestamp bigint"
DEFAULT_PARTITIONS = 8
#: Records of a segment that one input partition reads, and that a task writes to a segment.
SEGMENT_ROWS = 100_000

_STORED = pa.schema([("key", pa.string()), ("value", pa.string()), ("timestamp", pa.int64())])
_OUT = pa.schema([("key", pa.string()), ("value", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("timestamp", pa.int64())])


@dataclass(frozen=True)
class Segment:
    path: str
    partition: int
    start: int
    end: int


class Topic:
    """The folder of a topic."""

    def __init__(self, path: str):
        if "://" in path or path.startswith("file:"):
            self.fs, self.root = pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and "://" not in path else path)
        else:
            self.fs, self.root = pafs.LocalFileSystem(), path.rstrip("/")

    def _files(self, folder: str) -> list[str]:
        return sorted(f.path for f in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{folder}", allow_not_found=True)) if f.type == pafs.FileType.File)

    def exists(self, path: str) -> bool:
        return self.fs.get_file_info(path).type != pafs.FileType.NotFound

    def partitions(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        return sorted(int(f.base_name.split("=")[1]) for f in found if f.base_name.startswith("partition="))

    def segments(self, partition: int) -> list[Segment]:
        """In order of offsets, as far as they follow each other."""
        out: list[Segment] = []
        for path in self._files(f"partition={partition}"):
            first, n = path.rsplit("/", 1)[1].removesuffix(".parquet").split("-")
            if int(first) == (out[-1].end if out else 0):
                out.append(Segment(path, partition, int(first), int(first) + int(n)))
        return out

    def ends(self) -> dict[str, int]:
        return {str(p): s[-1].end if (s := self.segments(p)) else 0 for p in self.partitions()}

    def create(self, partitions: int) -> None:
        for p in range(partitions):
            self.fs.create_dir(f"{self.root}/partition={p}", recursive=True)

    def stage(self, records: list[tuple], partition: int) -> tuple[int, str, int]:
        """(partition, path, number) of a written segment that no reader sees yet."""
        self.fs.create_dir(f"{self.root}/_staged", recursive=True)
        path = f"{self.root}/_staged/{uuid.uuid4().hex}.parquet"
        columns = list(zip(*records, strict=True))
        with self.fs.open_output_stream(path) as out:
            pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, _STORED, strict=True)], schema=_STORED), out)
        return partition, path, len(records)

    def drop(self, staged: list[tuple[int, str, int]]) -> None:
        for _, path, _ in staged:
            if self.exists(path):
                self.fs.delete_file(path)

    def commit(self, name: str, staged: list[tuple[int, str, int]]) -> None:
        """Append the segments unless a commit of this name has appended its own."""
        plan = f"{self.root}/_commits/{name}.json"
        if self.exists(plan):
            mine = {path for _, path, _ in self._plan(plan)}
            self.drop([s for s in staged if s[1] not in mine])
        else:
            self.finish()
            ends, moves = self.ends(), []
            for partition, path, n in sorted(staged):
                moves.append((partition, path, f"{self.root}/partition={partition}/{ends[str(partition)]:020d}-{n}.parquet"))
                ends[str(partition)] += n
            self.fs.create_dir(f"{self.root}/_commits", recursive=True)
            draft = f"{self.root}/_staged/{uuid.uuid4().hex}.json"
            self.fs.create_dir(f"{self.root}/_staged", recursive=True)
            with self.fs.open_output_stream(draft) as out:
                out.write(json.dumps(moves).encode())
            self.fs.move(draft, plan)  # from here on the batch is appended
        self._apply(plan)

    def _plan(self, plan: str) -> list[list]:
        with self.fs.open_input_stream(plan) as f:
            return json.loads(f.read())

    def _apply(self, plan: str) -> None:
        for _, path, to in self._plan(plan):
            if not self.exists(to):
                self.fs.move(path, to)

    def finish(self) -> None:
        """Finish the newest plan, should its writer have failed in between. Earlier ones were finished before it was made."""
        plans = [f for f in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/_commits", allow_not_found=True)) if f.type == pafs.FileType.File]
        if plans:
            newest = max(plans, key=lambda f: (f.mtime_ns or 0, f.path))
            for plan in {newest.path, *(f.path for f in plans if f.mtime_ns == newest.mtime_ns)}:
                self._apply(plan)


@dataclass
class Span(InputPartition):
    """Offsets start to end of a segment."""
    segment: Segment
    start: int
    end: int


def _spans(topic: Topic, start: dict, end: dict) -> list[Span]:
    """What lies between two offsets, in pieces of at most SEGMENT_ROWS records; a partition that is not in ``start`` begins at 0."""
    out = []
    for p, stop in end.items():
        begin = start.get(p, 0)
        for s in topic.segments(int(p)) if stop > begin else ():
            lo, hi = max(begin, s.start), min(stop, s.end)
            out += [Span(s, a, min(a + SEGMENT_ROWS, hi)) for a in range(lo, hi, SEGMENT_ROWS)]
    return out


def _read(path: str, span: Span) -> Iterator[pa.RecordBatch]:
    topic = Topic(path)
    with topic.fs.open_input_file(span.segment.path) as f:
        table = pq.read_table(f).slice(span.start - span.segment.start, span.end - span.start)
    n = table.num_rows
    full = pa.table([table["key"], table["value"], pa.array([span.segment.partition] * n, pa.int32()), pa.array(range(span.start, span.end), pa.int64()), table["timestamp"]],
                    schema=_OUT)
    yield from full.to_batches(max_chunksize=10_000)


class TopicReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Span]:
        topic = Topic(self.path)
        return _spans(topic, {}, topic.ends())

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else _read(self.path, partition)


class TopicStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, starting: str):
        if starting not in ("latest", "earliest"):
            raise ValueError("startingOffsets is latest or earliest")
        self.path, self.starting = path, starting

    def initialOffset(self) -> dict:
        ends = Topic(self.path).ends()
        return ends if self.starting == "latest" else dict.fromkeys(ends, 0)

    def latestOffset(self) -> dict:
        return Topic(self.path).ends()

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return _spans(Topic(self.path), start, end)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


@dataclass
class Staged(WriterCommitMessage):
    segments: list


def partition_of(key: str | None, value: str | None, partitions: int) -> int:
    """Records of a key share a partition; records without one are dealt by their value."""
    return zlib.crc32((key if key is not None else value or "").encode()) % partitions


def _stage(path: str, partitions: int, rows: Iterator) -> Staged:
    """Rows with key and value, and a timestamp if they have one."""
    topic, held, done, now = Topic(path), {}, [], int(time.time() * 1000)
    for r in rows:
        names = r.__fields__
        key = r["key"] if "key" in names else None
        p = partition_of(key, r["value"], partitions)
        own = held.setdefault(p, [])
        own.append((key, r["value"], r["timestamp"] if "timestamp" in names and r["timestamp"] is not None else now))
        if len(own) == SEGMENT_ROWS:
            done.append(topic.stage(held.pop(p), p))
    done += [topic.stage(own, p) for p, own in sorted(held.items())]
    return Staged(done)


def _segments(messages: list) -> list[tuple[int, str, int]]:
    return [tuple(s) for m in messages if m is not None for s in m.segments]


class TopicWriter(DataSourceWriter):
    def __init__(self, path: str, partitions: int):
        self.path, self.partitions, self.name = path, partitions, f"batch-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Staged:
        return _stage(self.path, self.partitions, iterator)

    def commit(self, messages: list) -> None:
        Topic(self.path).commit(self.name, _segments(messages))

    def abort(self, messages: list) -> None:
        Topic(self.path).drop(_segments(messages))


class TopicStreamWriter(DataSourceStreamWriter):
    def __init__(self, path: str, partitions: int, writer: str):
        self.path, self.partitions, self.writer = path, partitions, writer

    def write(self, iterator: Iterator) -> Staged:
        return _stage(self.path, self.partitions, iterator)

    def commit(self, messages: list, batchId: int) -> None:
        Topic(self.path).commit(f"{self.writer}-{batchId}", _segments(messages))

    def abort(self, messages: list, batchId: int) -> None:
        Topic(self.path).drop(_segments(messages))


class TopicSource(DataSource):
    """``format("topic")`` with the topic's folder as path. Options: startingOffsets, partitions (of a topic that is made), writer."""

    @classmethod
    def name(cls) -> str:
        return "topic"

    def schema(self) -> str:
        return SCHEMA

    def _made(self) -> tuple[str, int]:
        topic = Topic(self.options["path"])
        if not topic.partitions():
            topic.create(int(self.options.get("partitions", DEFAULT_PARTITIONS)))
        return self.options["path"], len(topic.partitions())

    def reader(self, schema) -> DataSourceReader:
        return TopicReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TopicStreamReader(self.options["path"], self.options.get("startingoffsets", self.options.get("startingOffsets", "latest")))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a topic is only appended to")
        return TopicWriter(*self._made())

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return TopicStreamWriter(*self._made(), self.options.get("writer", "stream"))


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(TopicSource)


def append(records: DataFrame, path: str, partitions: int = DEFAULT_PARTITIONS) -> None:
    """Append (key, value) records to the topic, which is made if it is not there."""
    register(records.sparkSession)
    records.select("key", "value").write.format("topic").option("partitions", partitions).mode("append").save(path)


def start_topic_filter(spark: SparkSession, source: str, target: str, checkpoint: str, starting: str = "latest", trigger: dict | None = None):
    """Log records of one topic in, the rating messages they carry out to
    another, under the same key."""
    register(spark)
    log = spark.readStream.format("topic").option("startingOffsets", starting).load(source)
    out = filter_log(log, "value").select("key", F.col("message").alias("value"))
    writer = out.writeStream.format("topic").option("checkpointLocation", checkpoint).option("path", target).option("writer", "filter")
    return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()
