"""Queries over segment files, the topic store and streams. What they write goes when the application ends."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidelog.operators import topics, txn
from tidelog.plans import state, stored
from tidelog.plans.registry import query
from tidelog.plans.sqltext import EVENTS, SEQUENCES
from tidelog.sources import seglog
from tidelog.sources.store import Store, TopicConfig, TransactionalProducer
from tidelog.streaming import stateful

_SHOWN = ["partition", "offset", "timestamp", "key", "value"]
_SHOWN_SQL = 'partition, "offset", timestamp, key, value'
SEGMENT = 500


def _segments(spark: SparkSession, sf_dir: str, torn: bool = False) -> str:
    """The events as segment files of SEGMENT records, on a path that all executors see; `torn`: each partition's last file lacks its end."""
    seglog.register(spark)

    def make(path: str) -> None:
        seglog.write(stored.events(spark, sf_dir), path, segment_records=SEGMENT)
        for folder in os.listdir(path) if torn else ():
            last = max(f for f in os.listdir(os.path.join(path, folder)) if f.endswith(".log"))
            with open(os.path.join(path, folder, last), "r+b") as f:
                f.truncate(os.path.getsize(f.name) - 3)

    return _plain(stored.made(spark, sf_dir, "events", f"segments-{torn}", lambda path: make(_plain(path))))


def _plain(path: str) -> str:
    """A path of Spark's as Python's: segment files are on a file system that all executors have mounted."""
    return re.sub("^file:/*", "/", path)


def _texts(records: DataFrame) -> DataFrame:
    return records.select("partition", "offset", "timestamp", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


@query("seglog_scan", f"WITH {EVENTS} SELECT {_SHOWN_SQL} FROM topic")
def seglog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records from segment files that were written before."""
    return _texts(spark.read.format("seglog").option("path", _segments(spark, sf_dir)).load())


@query("seglog_from_offset", f'WITH {EVENTS} SELECT {_SHOWN_SQL} FROM topic WHERE partition = 3 AND "offset" >= 100 AND "offset" < 700')
def seglog_from_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition from an offset to another; other files aren't opened."""
    return _texts(spark.read.format("seglog").options(path=_segments(spark, sf_dir), partition=3, startOffset=100, endOffset=700).load())


@query("seglog_recovery", f"WITH {EVENTS} SELECT partition, count(*) - 1 AS records, max(\"offset\") AS next_offset, 1 AS torn FROM topic GROUP BY 1")
def seglog_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each log goes on after its last record was torn."""
    rows = spark.read.format("seglog").options(path=_segments(spark, sf_dir, True), corrupt="rows").load()
    return rows.groupBy("partition").agg(F.count("offset").alias("records"), (F.max("offset") + 1).alias("next_offset"), F.count("error").alias("torn"))


def _store(spark: SparkSession) -> Store:
    return Store(spark, stored.temporary(spark, f"store-{uuid.uuid4().hex}"))


@query("store_append", f"WITH {EVENTS} SELECT {_SHOWN_SQL} FROM topic")
def store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events appended to a topic in two goes; offsets go on, and are those of one go."""
    e = topics.table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), topics.millis("ts", e).alias("timestamp"), "event_id", "ts")
    middle = rows.agg(F.percentile_approx("timestamp", 0.5)).first()[0]
    store = _store(spark)
    store.create("events", topics.PARTITIONS)
    for part in (F.col("timestamp") <= middle, F.col("timestamp") > middle) if middle is not None else ():
        store.append("events", rows.where(part), ["timestamp", "ts", "event_id"])
    return store.read("events").select(*_SHOWN)


@query("store_catalog", """WITH t AS (SELECT r_name AS name, count(*) + 1 AS partitions FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)
SELECT name, CAST(CASE WHEN name = 'ASIA' THEN partitions + 2 ELSE partitions END AS INTEGER) AS partitions, CASE WHEN name = 'EUROPE' THEN 'compact' ELSE 'delete' END AS cleanup FROM t WHERE name <> 'AFRICA'""")
def store_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics made for the regions, of which one grows and one is deleted."""
    nations = topics.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).count()
    regions = topics.table(spark, sf_dir, "region").join(nations, "r_regionkey").select("r_name", "count").collect()
    store = _store(spark)
    for r in regions:
        store.create(r["r_name"], r["count"] + 1, TopicConfig(cleanup="compact" if r["r_name"] == "EUROPE" else "delete"))
    store.grow("ASIA", store.describe("ASIA")[0] + 2)
    store.delete("AFRICA")
    return store.topics().select("name", "partitions", F.get_json_object("config", "$.cleanup").alias("cleanup"))


@query("store_offsets", """WITH o AS (SELECT CAST(o_custkey % 8 AS INTEGER) AS topic_partition, max(o_orderkey) AS top, min(o_orderkey) AS low FROM orders GROUP BY 1)
SELECT topic_partition, CASE WHEN topic_partition % 2 = 0 THEN top ELSE low END AS committed FROM o WHERE topic_partition <> 5""")
def store_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a group has committed: all partitions, then the even ones again, and one has been deleted."""
    o = topics.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 8).cast("int").alias("topic_partition")).agg(F.max("o_orderkey").alias("top"), F.min("o_orderkey").alias("low"))
    store = _store(spark)
    store.commit("g", "orders", o.select("topic_partition", F.col("low").alias("committed")), 0)
    store.commit("g", "orders", o.where("topic_partition % 2 = 0 OR topic_partition = 5").select("topic_partition", F.when(F.col("topic_partition") != 5, F.col("top")).alias("committed")), 1)
    return store.committed("g", "orders", 2)


@query("store_transactions", f"WITH {EVENTS} SELECT key, value FROM topic WHERE user_id % 3 = 0")
def store_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A producer commits a third of the events and aborts another; one that was started since is let, the first no more."""
    e = topics.table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), topics.millis("ts", e).alias("timestamp"), "user_id", "event_id")
    store = _store(spark)
    store.create("t", topics.PARTITIONS)
    producer = TransactionalProducer(store, "p")
    for third, end in ((0, producer.commit), (1, producer.abort)):
        producer.begin()
        producer.send("t", rows.where(F.col("user_id") % 3 == third), ["timestamp", "event_id"])
        end()
    producer.begin()
    producer.send("t", rows.where(F.col("user_id") % 3 == 2), ["timestamp", "event_id"])  # left open
    return txn.read_committed_lso(store.read("t")).select("key", "value")


def _streamed(spark: SparkSession, writer: DataStreamWriter, schema) -> DataFrame:
    """All that there is, taken by a stream that commits its place, and what it wrote."""
    path = stored.temporary(spark, f"stream-{uuid.uuid4().hex}")
    running = writer.option("checkpointLocation", f"{path}/place").option("path", f"{path}/rows").trigger(availableNow=True).format("parquet").start()
    running.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/rows")


def _live(spark: SparkSession, rows: DataFrame, by: str) -> DataFrame:
    """`rows` as a stream of three micro-batches, in the order of a column: files arrive one after the other."""
    path = stored.temporary(spark, f"input-{uuid.uuid4().hex}")
    low, high = rows.agg(F.percentile_approx(by, [0.33, 0.67])).first()[0] or (0, 0)
    for part in (F.col(by) <= low, (F.col(by) > low) & (F.col(by) <= high), F.col(by) > high):
        rows.where(part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_poll", f"WITH {EVENTS} SELECT {_SHOWN_SQL} FROM topic")
def stream_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A poll loop over segment files as a stream, whose place is committed with each batch."""
    rows = _texts(spark.readStream.format("seglog").option("path", _segments(spark, sf_dir)).load())
    return _streamed(spark, rows.writeStream.outputMode("append"), rows.schema)


@query("stream_committed", f"""WITH {EVENTS} SELECT partition, "offset", key, value FROM topic t WHERE marker IS NULL
AND NOT EXISTS (SELECT 1 FROM topic a WHERE a.marker = 'ABORT' AND a.transaction_id = t.transaction_id AND a.partition = t.partition AND a."offset" < t."offset")""")
def stream_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 on a stream: a transaction's state lives on from batch to batch."""
    rows = stored.events(spark, sf_dir).select("partition", "offset", "key", "value", "transaction_id", "marker")
    got = stateful.read_committed(_live(spark, rows, "offset"))
    return _streamed(spark, got.writeStream.outputMode("append"), got.schema).select("partition", "offset", "key", "value")


@query("stream_deduplicated", f"WITH RECURSIVE {EVENTS}, {SEQUENCES} SELECT user_id, event_id, n, seq FROM checked WHERE verdict = 'ACCEPT'")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4 on a stream: what an idempotent producer's records come to."""
    rows = state.sequences(spark, sf_dir).select("user_id", "event_id", "n", "seq")
    got = stateful.deduplicated(_live(spark, rows, "n"))
    return _streamed(spark, got.writeStream.outputMode("append"), got.schema)
