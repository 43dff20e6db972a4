"""Segment files as a Spark data source: `spark.read.format("seglog")`, `readStream` and a batch writer.

A topic is a directory `<topic>/<partition>/<20-digit base offset>.log` of frames (functions.frames).
Offsets are not in the frames: a record's is its file's base offset and its place there. A scan of a
file ends at the first frame that can't be read; with option `corrupt=rows` what is left is
reported as a row with `error` and `corrupt_bytes`.

Files are one task each. Options `startOffset`, `endOffset` (exclusive) and `partition` drop whole
files by their names alone: a file whose successor begins at or before the wanted offset is not
opened. (Filters are not used for that: Spark 4.1 keeps what a Python reader made of the first
query's filters for later queries on the same DataFrame.) Paths are local or on a mount that all
executors share.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from tidelog.functions.frames import bound, crc32c_many, pack_many, parsed

SCHEMA = "partition int, offset long, timestamp long, key binary, value binary, attributes int, error string, corrupt_bytes long"
BLOCK = 4 << 20
_FILE = re.compile(r"^(\d{20})\.log$")


@dataclass
class Segment(InputPartition):
    path: str
    partition: int
    base: int
    start: int = 0
    stop: int | None = None


def segments(path: str) -> list[Segment]:
    """All files of a topic by partition and base offset; `stop` is where the next file begins."""
    out = []
    for name in sorted(os.listdir(path), key=lambda n: (len(n), n)):
        if name.isdigit():
            files = sorted((int(m[1]), f) for f in os.listdir(os.path.join(path, name)) if (m := _FILE.match(f)))
            ends = [base for base, _ in files[1:]] + [None]
            out += [Segment(os.path.join(path, name, f), int(name), base, 0, end) for (base, f), end in zip(files, ends, strict=True)]
    return out


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.int64()]


def _frames(path: str, at: int, offset: int, stop: int | None = None) -> Iterator[tuple[int, list[tuple]]]:
    """Lists of (timestamp, key, value, attributes) with the offset of the first, from byte `at` on.

    The last list ends with (error, bytes left) if there is a frame that can't be read. A file is read BLOCK bytes at
    a time, and what is whole in a block is checked at once, so memory has a block and a frame at most.
    """
    with open(path, "rb") as f:
        f.seek(at)
        held, size = b"", stop if stop is not None else os.fstat(f.fileno()).st_size
        while at < size:
            held += f.read(min(BLOCK, size - at - len(held)))
            last = at + len(held) >= size
            ends, error, begin = [], None, 0
            while begin < len(held):
                try:
                    begin = bound(held, begin)
                except ValueError as e:
                    # A frame that is cut off may only be so by the end of the block.
                    error = str(e) if last or "range" in str(e) else None
                    break
                ends.append(begin)
            whole = [held[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            out: list[tuple] = []
            done = 0
            for frame, crc, end in zip(whole, crc32c_many([x[8:] for x in whole]), ends, strict=True):
                try:
                    out.append(parsed(frame, crc))
                except ValueError as e:
                    error = str(e)
                    break
                done = end
            at, held = at + done, held[done:]
            if error:
                yield offset, [*out, (error, size - at)]
                return
            yield offset, out
            offset += len(out)


def _batches(path: str, partition: int, at: int, base: int, low: int, high: int | None, report: bool, stop: int | None = None) -> Iterator[pa.RecordBatch]:
    for first, rows in _frames(path, at, base, stop):
        error = rows.pop() if rows and len(rows[-1]) == 2 else None
        a, b = max(0, low - first), len(rows) if high is None else max(0, min(len(rows), high - first))
        out = [(partition, first + i, t, k, v, x, None, None) for i, (t, k, v, x) in enumerate(rows[a:b], a)]
        if error and report:
            out.append((partition, None, None, None, None, None, *error))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), _KINDS, strict=True)], _NAMES)
        if high is not None and first + len(rows) >= high:
            return


def scan(segment: Segment, report: bool, high: int | None = None) -> Iterator[pa.RecordBatch]:
    return _batches(segment.path, segment.partition, 0, segment.base, segment.start, high, report)


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.report = options["path"], options.get("corrupt") == "rows"
        self.low, self.high = int(options.get("startOffset", 0)), int(options["endOffset"]) if "endOffset" in options else None
        self.only = int(options["partition"]) if "partition" in options else None

    def partitions(self) -> list[InputPartition]:
        found = [s for s in segments(self.path) if self.only in (None, s.partition) and (s.stop is None or s.stop > self.low) and (self.high is None or s.base < self.high)]
        for s in found:
            s.start = self.low
        return list(found)

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return scan(partition, self.report, self.high)


@dataclass
class Tail(InputPartition):
    path: str
    partition: int
    byte: int
    offset: int
    stop: int


class StreamReader(DataSourceStreamReader):
    """A position has, for each file, the byte and the offset up to which whole frames have been seen.

    The driver hops from length to length over what is new; tasks read from there on, so no byte is read twice. Option `startingOffsets` is
    `earliest` (default) or `latest`.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.late = options["path"], options.get("startingOffsets", "earliest") == "latest"
        self.seen: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.late else {}

    def latestOffset(self) -> dict:
        out = {}
        for s in segments(self.path):
            at, offset = self.seen.get(s.path, [0, s.base])
            size = os.path.getsize(s.path)
            with open(s.path, "rb") as f:
                while at + 8 <= size:
                    f.seek(at)
                    end = at + 4 + int.from_bytes(f.read(4), "big")
                    if end > size:
                        break
                    at, offset = end, offset + 1
            out[s.path] = self.seen[s.path] = [at, offset]
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        by_path = {s.path: s for s in segments(self.path)}
        out = []
        for path, (stop, _) in end.items():
            s = by_path[path]
            at, offset = start.get(path, [0, s.base])
            if stop > at:
                out.append(Tail(path, s.partition, at, offset, stop))
        return list(out)

    def read(self, partition: Tail) -> Iterator[tuple]:
        for batch in _batches(partition.path, partition.partition, partition.byte, partition.offset, 0, None, False, partition.stop):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    """Rows of a task must be sorted by partition and offset, and no stretch of `segmentRecords` offsets of a partition be in two tasks."""

    def __init__(self, options: dict) -> None:
        self.path, self.limit, self.records = options["path"], int(options.get("segmentBytes", 1 << 30)), int(options.get("segmentRecords", 1 << 20))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, out, filled, now = [], None, 0, None
        tag = uuid.uuid4().hex  # no other task's, on whatever host
        for batch in batches:
            partitions, offsets, *columns = (batch.column(c).to_pylist() for c in ("partition", "offset", "timestamp", "key", "value"))
            frames = pack_many((t, k, v or b"") for t, k, v in zip(*columns, strict=True))
            for partition, offset, frame in zip(partitions, offsets, frames, strict=True):
                place = partition, offset // self.records
                if place != now or filled >= self.limit:
                    if out:
                        out.close()
                    folder = os.path.join(self.path, str(partition))
                    os.makedirs(folder, exist_ok=True)
                    final = os.path.join(folder, f"{offset:020d}.log")
                    part = f"{final}.part-{tag}-{len(files)}"
                    files.append((part, final))
                    out, filled, now = open(part, "wb"), 0, place  # noqa: SIM115
                out.write(frame)
                filled += len(frame)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        for message in messages:
            for part, final in message.files if message else ():
                os.replace(part, final)

    def abort(self, messages: list) -> None:
        for message in messages:
            for part, _ in message.files if message else ():
                if os.path.exists(part):
                    os.remove(part)


class SegmentLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "seglog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SegmentLog)


def write(topic, path: str, segment_bytes: int = 1 << 30, segment_records: int = 1 << 20) -> None:
    """Write (partition, offset, timestamp, key, value) rows as segment files; a partition is written by a task for each `segment_records` offsets."""
    from pyspark.sql import functions as F

    rows = topic.select("partition", "offset", "timestamp", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    nothing = {"attributes": F.lit(0), "error": F.lit(None).cast("string"), "corrupt_bytes": F.lit(None).cast("long")}
    dealt = rows.withColumns(nothing).repartition("partition", F.floor(F.col("offset") / segment_records)).sortWithinPartitions("partition", "offset")
    dealt.write.format("seglog").mode("append").option("path", path).option("segmentBytes", str(segment_bytes)).option("segmentRecords", str(segment_records)).save()
