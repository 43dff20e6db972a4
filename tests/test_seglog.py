"""Segment files: frames, round trips, pushed filters, torn files and streams."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tidelog.functions import codecs, frames
from tidelog.sources import seglog


def test_checksum_and_frames():
    assert frames.crc32c(b"123456789") == 0xE3069283
    for key in (None, b"", b"k" * 9):
        raw = frames.pack(5, key, b"value")
        assert frames.unpack(raw)[:3] == (5, key, b"value")
        assert len(raw) == 26 + len(key or b"") + 5
    raw = bytearray(frames.pack(5, b"k", b"value"))
    raw[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        frames.unpack(bytes(raw))
    with pytest.raises(ValueError, match="cut off"):
        frames.unpack(bytes(raw[:-1]))


def test_checksums_side_by_side():
    parts = [os.urandom(n) for n in (0, 1, 7, 8, 9, 100, 4095, 4096, 4097, 9000, 3, 3)]
    assert frames.crc32c_many(parts) == [frames.crc32c(x) for x in parts] and frames.crc32c_many([]) == []
    rows = [(5, None, b"v"), (6, b"", b""), (7, b"k" * 5000, b"x" * 9)]
    assert frames.pack_many(rows) == [frames.pack(*r) for r in rows]


@pytest.mark.parametrize("name", codecs.CODECS)
def test_codecs(name):
    put, get = codecs.codec(name)
    for b in (b"", b"a" * 1000, os.urandom(100)):
        assert get(put(b), len(b)) == b


@pytest.fixture
def topic(spark, tmp_path):
    seglog.register(spark)
    rows = spark.range(1000).select((F.col("id") % 3).cast("int").alias("partition"), F.floor(F.col("id") / 3).alias("offset"), (F.col("id") * 10).alias("timestamp"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("k"), F.col("id"))).alias("key"), F.concat(F.lit("v"), F.col("id")).alias("value"))
    path = str(tmp_path / "topic")
    seglog.write(rows, path, 2000)
    return rows, path


def test_round_trip_and_pushdown(spark, topic):
    rows, path = topic
    assert len(glob.glob(f"{path}/0/*.log")) > 3
    back = spark.read.format("seglog").option("path", path).load()
    shown = back.select("partition", "offset", "timestamp", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))
    assert shown.exceptAll(rows).isEmpty() and rows.exceptAll(shown).isEmpty()
    part = spark.read.format("seglog").options(path=path, partition=1, startOffset=300, endOffset=320).load()
    assert part.count() == rows.where("partition = 1 and offset >= 300 and offset < 320").count()
    assert part.rdd.getNumPartitions() < back.rdd.getNumPartitions() / 3


def test_a_torn_file_ends_its_scan(spark, topic):
    _, path = topic
    last = sorted(glob.glob(f"{path}/2/*.log"))[-1]
    with open(last, "r+b") as f:
        f.truncate(os.path.getsize(last) - 3)
    read = spark.read.format("seglog").option("path", path)
    assert read.load().count() == 999
    torn = read.option("corrupt", "rows").load().where("error is not null").collect()
    assert len(torn) == 1 and torn[0].corrupt_bytes > 0


def test_stream(spark, topic, tmp_path):
    rows, path = topic
    stream = spark.readStream.format("seglog").option("path", path).load()
    q = stream.writeStream.format("memory").queryName("seglog_rows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seglog_rows").count() == 1000


def test_stream_reads_on_from_where_it_was(spark, tmp_path):
    """Positions are bytes and offsets: what is appended is read once, also by a reader that starts again, and a torn frame waits."""
    path = tmp_path / "topic" / "0"
    path.mkdir(parents=True)
    frame = [frames.pack(i, None, f"v{i}".encode()) for i in range(30)]
    log = path / f"{0:020d}.log"
    log.write_bytes(b"".join(frame[:10]) + frame[10][:7])
    reader = seglog.StreamReader({"path": str(tmp_path / "topic")})
    first = reader.latestOffset()
    read = lambda a, b: [r[1] for p in seglog.StreamReader({"path": str(tmp_path / "topic")}).partitions(a, b) for r in reader.read(p)]
    assert read(reader.initialOffset(), first) == list(range(10)) and first[str(log)] == [sum(map(len, frame[:10])), 10]
    log.write_bytes(b"".join(frame[:20]))
    (path / f"{20:020d}.log").write_bytes(b"".join(frame[20:]))
    second = reader.latestOffset()
    assert read(first, second) == list(range(10, 30)) and read(second, reader.latestOffset()) == []
    assert seglog.StreamReader({"path": str(tmp_path / "topic")}).latestOffset() == second
    late = seglog.StreamReader({"path": str(tmp_path / "topic"), "startingOffsets": "latest"})
    assert read(late.initialOffset(), late.latestOffset()) == []


def test_files_larger_than_a_block(tmp_path, monkeypatch):
    monkeypatch.setattr(seglog, "BLOCK", 64)
    path = tmp_path / "x.log"
    values = [os.urandom(n) for n in (0, 1, 500, 63, 64, 65, 3000, 2)]
    path.write_bytes(b"".join(frames.pack(i, b"k" * i, v) for i, v in enumerate(values)))
    scanned = lambda: [tuple(r.values()) for b in seglog.scan(seglog.Segment(str(path), 3, 100), True) for r in b.to_pylist()]
    got = scanned()
    assert [(r[1], r[2], r[3], r[4]) for r in got] == [(100 + i, i, b"k" * i, v) for i, v in enumerate(values)]
    path.write_bytes(path.read_bytes()[:-1])
    got = scanned()
    assert len(got) == 8 and got[-1][6] == "the frame is cut off" and got[-1][7] == 26 + 7 + 2 - 1


def test_a_partition_is_written_by_several_tasks(spark, tmp_path):
    seglog.register(spark)
    rows = spark.range(1000).select(F.lit(0).alias("partition"), F.col("id").alias("offset"), F.col("id").alias("timestamp"), F.lit(None).cast("string").alias("key"), F.col("id").cast("string").alias("value"))
    seglog.write(rows, str(tmp_path / "t"), segment_records=64)
    assert len(glob.glob(f"{tmp_path}/t/0/*.log")) == 16
    back = spark.read.format("seglog").option("path", str(tmp_path / "t")).load().orderBy("offset").collect()
    assert [(r.offset, r.value.decode()) for r in back] == [(i, str(i)) for i in range(1000)]
