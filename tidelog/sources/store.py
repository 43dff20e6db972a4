"""Topics as Parquet tables, with a catalog, appends that continue offsets, transactions and committed offsets.

Everything is a log: the catalog and the committed offsets are changelogs whose current state is the
latest row of each key. Records lie in `<base>/topics/<name>/partition=<p>/`, sorted by offset in
each file, so Parquet's statistics do what a sparse index does. One writer appends to a topic at a
time; readers see whole Spark commits only. Paths go to Spark's readers and writers alone, so any
store that Spark reaches will do.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.routing import md5_mod, partitioner
from tidelog.operators import offsets as offset_ops
from tidelog.operators import topics as topic_ops

RECORDS = "partition int, offset long, timestamp long, key string, value string, transaction_id string, marker string"
CATALOG = "version long, name string, partitions int, config string, deleted boolean"
PRODUCERS = "version long, transactional_id string, epoch int"
VOTES = "version long, node string, document string"
COMMITS = "seq long, group_id string, topic string, topic_partition int, committed long, expires long, slot int"
WEEK = 7 * 86_400_000
#: Partitions of the table of committed offsets, by a hash of the group.
SLOTS = 50


@dataclass
class TopicConfig:
    retention_hours: float = -1
    retention_bytes: int = -1
    segment_records: int = 100
    cleanup: str = "delete"
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.cleanup not in ("delete", "compact"):
            raise ValueError(f"unknown cleanup {self.cleanup!r}")


@dataclass
class ProducerConfig:
    """Rules of an idempotent producer: all replicas acknowledge, five requests in flight at most."""

    acks: int = -1
    max_in_flight: int = 5
    idempotent: bool = True
    batch_bytes: int = 16384
    linger_ms: int = 0

    def __post_init__(self) -> None:
        if self.acks not in (-1, 0, 1):
            raise ValueError("acks is -1, 0 or 1")
        if self.idempotent and (self.acks != -1 or self.max_in_flight > 5):
            raise ValueError("an idempotent producer needs acks=-1 and at most 5 requests in flight")


class Fenced(RuntimeError):
    """A producer with the same transactional id has been started since."""


class TransactionalProducer:
    """Sends records in transactions; one with the same id that was started before may do nothing any more.

    A transaction's records are visible to readers of committed records once its marker is written; the marker goes to
    every partition that it wrote to.
    """

    def __init__(self, store: Store, transactional_id: str) -> None:
        self.store, self.id = store, transactional_id
        self.epoch = store.start_producer(transactional_id)
        self._number, self._topics = 0, None

    @property
    def transaction_id(self) -> str:
        return f"{self.id}-{self.epoch}-{self._number}"

    def _check(self, inside: bool) -> None:
        if self.store.epoch(self.id) != self.epoch:
            raise Fenced(f"{self.id!r} has been started again")
        if inside != (self._topics is not None):
            raise ValueError("no transaction has begun" if inside else "a transaction has begun already")

    def begin(self) -> str:
        self._check(False)
        self._number, self._topics = self._number + 1, []
        return self.transaction_id

    def send(self, topic: str, records: DataFrame, order: list[str], by: str = "default") -> None:
        self._check(True)
        self.store.append(topic, records, order, by, self.transaction_id)
        if topic not in self._topics:
            self._topics.append(topic)

    def _end(self, marker: str) -> None:
        self._check(True)
        for topic in self._topics:
            self.store.end_transaction(topic, self.transaction_id, marker)
        self._topics = None

    def commit(self) -> None:
        self._end("COMMIT")

    def abort(self) -> None:
        self._end("ABORT")


class Store:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def _table(self, place: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.base}/{place}")
        except AnalysisException:  # nothing has been written yet
            return self.spark.createDataFrame([], schema)

    # The catalog.
    def topics(self) -> DataFrame:
        """name, partitions and config of the topics that there are."""
        last = self._table("catalog", CATALOG).groupBy("name").agg(F.max_by(F.struct("partitions", "config", "deleted", "version"), "version").alias("x"))
        return last.where(~F.col("x.deleted")).select("name", "x.partitions", "x.config", "x.version")

    def _enter(self, name: str, partitions: int, config: str, deleted: bool) -> None:
        version = (self._table("catalog", CATALOG).agg(F.max("version")).first()[0] or 0) + 1
        self.spark.createDataFrame([(version, name, partitions, config, deleted)], CATALOG).coalesce(1).write.mode("append").parquet(f"{self.base}/catalog")

    def describe(self, name: str) -> tuple[int, TopicConfig, int]:
        """partitions, config, and the version in which the topic was entered last."""
        row = self.topics().where(F.col("name") == name).first()
        if row is None:
            raise KeyError(f"no topic {name!r}")
        return row["partitions"], TopicConfig(**json.loads(row["config"])), row["version"]

    def create(self, name: str, partitions: int, config: TopicConfig | None = None) -> None:
        if partitions < 1:
            raise ValueError("a topic has a partition at least")
        if not self.topics().where(F.col("name") == name).isEmpty():
            raise ValueError(f"there is a topic {name!r} already")
        self._enter(name, partitions, json.dumps(asdict(config or TopicConfig())), False)

    def grow(self, name: str, partitions: int) -> None:
        now, config, _ = self.describe(name)
        if partitions <= now:
            raise ValueError("partitions can only be added")
        self._enter(name, partitions, json.dumps(asdict(config)), False)

    def delete(self, name: str) -> None:
        partitions, config, _ = self.describe(name)
        self._enter(name, partitions, json.dumps(asdict(config)), True)

    def _place(self, name: str) -> str:
        """Where a topic's records are: a name used again after deletion has a new place."""
        gone = self._table("catalog", CATALOG).where((F.col("name") == name) & F.col("deleted")).count()
        return f"topics/{name}-{gone}"

    # Records.
    def read(self, name: str, start: int = 0) -> DataFrame:
        self.describe(name)
        return self._table(self._place(name), RECORDS).where(F.col("offset") >= start)

    def usage(self, name: str) -> DataFrame:
        """partition, files and bytes on disk of a topic."""
        self.describe(name)
        files = self._table(self._place(name), RECORDS)
        if not files.inputFiles():
            return self.spark.createDataFrame([], "partition int, files long, bytes long")
        each = files.select("partition", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).distinct()
        return each.groupBy("partition").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))

    def append(self, name: str, records: DataFrame, order: list[str], by: str = "default", transaction_id: str | None = None, stretch: int = 3_600_000) -> None:
        """Route (key, value, timestamp, ...) rows and write them behind what is there, in `order` per partition.

        Rows are numbered in stretches of the first (numeric) column of the order, so no task has a whole partition.
        """
        n, _, _ = self.describe(name)
        rows = records
        for column, kind in (("key", "string"), ("value", "string"), ("timestamp", "long"), ("marker", "string"), ("transaction_id", "string")):
            if column not in rows.columns:
                rows = rows.withColumn(column, F.lit(transaction_id if column == "transaction_id" else None).cast(kind))
        if "partition" not in rows.columns:
            first = F.floor(F.col(order[0]) / stretch)
            keyless = topic_ops.globally_numbered(rows.where("key is null"), first, order, "_nth") if by in ("default", "sticky") else None
            if by == "round_robin":
                rows = topic_ops.globally_numbered(rows, first, order, "_nth")
            elif keyless is not None:
                rows = keyless.unionByName(rows.where("key is not null").withColumn("_nth", F.lit(None).cast("long")))
            else:
                rows = rows.withColumn("_nth", F.lit(0).cast("long"))
            rows = rows.withColumn("partition", partitioner(by)(F.col("key"), F.col("_nth"), n))
        ends = self.read(name).groupBy("partition").agg((F.max("offset") + 1).alias("_end"))
        numbered = topic_ops.numbered(rows, order, "_nr", stretch=F.floor(F.col(order[0]) / stretch)).join(F.broadcast(ends), "partition", "left")  # a row for each partition
        out = numbered.withColumn("offset", F.col("_nr") + F.coalesce("_end", F.lit(0))).select(*(c.split()[0] for c in RECORDS.split(", ")))
        topic_ops.write(out, f"{self.base}/{self._place(name)}", "append")

    def end_transaction(self, name: str, transaction_id: str, marker: str) -> None:
        """A COMMIT or ABORT marker in every partition that the transaction wrote to."""
        if marker not in ("COMMIT", "ABORT"):
            raise ValueError("a marker is COMMIT or ABORT")
        touched = self.read(name).where(F.col("transaction_id") == transaction_id).groupBy("partition").agg(F.max("timestamp").alias("timestamp"))
        marks = touched.select("partition", "timestamp", F.lit(None).cast("string").alias("key"), F.lit("").alias("value"), F.lit(marker).alias("marker"), F.lit(transaction_id).alias("transaction_id"))
        self.append(name, marks, ["timestamp"])

    def list_offsets(self, name: str, at: int) -> DataFrame:
        return topic_ops.list_offsets(self.read(name), at)

    # Producers and votes.
    def epoch(self, transactional_id: str) -> int | None:
        """The epoch of the producer that was started last with this id."""
        rows = self._table("producers", PRODUCERS).where(F.col("transactional_id") == transactional_id)
        return rows.agg(F.max("epoch")).first()[0]

    def start_producer(self, transactional_id: str) -> int:
        """A new epoch, which fences those before; what they left open is aborted by the caller or stays unseen."""
        version = (self._table("producers", PRODUCERS).agg(F.max("version")).first()[0] or 0) + 1
        before = self.epoch(transactional_id)
        epoch = 0 if before is None else before + 1
        self.spark.createDataFrame([(version, transactional_id, epoch)], PRODUCERS).coalesce(1).write.mode("append").parquet(f"{self.base}/producers")
        return epoch

    def vote(self, node: str, term: int, voted_for: str | None) -> None:
        """A node's term and vote, which it must remember when it starts again; terms never fall, and a vote stands for its term."""
        now, given = self.voted(node)
        if term < now or (term == now and given not in (None, voted_for)):
            raise ValueError(f"{node!r} has voted in term {now} already")
        version = (self._table("votes", VOTES).agg(F.max("version")).first()[0] or 0) + 1
        document = json.dumps({"current_term": term, "voted_for": voted_for})
        self.spark.createDataFrame([(version, node, document)], VOTES).coalesce(1).write.mode("append").parquet(f"{self.base}/votes")

    def voted(self, node: str) -> tuple[int, str | None]:
        rows = self._table("votes", VOTES).where(F.col("node") == node).agg(F.max_by("document", "version"))
        found = json.loads(rows.first()[0] or "{}")
        return found.get("current_term", 0), found.get("voted_for")

    # Committed offsets.
    def commit(self, group: str, name: str, positions: DataFrame, now: int, keep: int = WEEK) -> None:
        """positions: topic_partition, committed (null deletes)."""
        seq = (self._table("offsets", COMMITS).agg(F.max("seq")).first()[0] or 0) + 1
        rows = positions.select(F.lit(seq).cast("long").alias("seq"), F.lit(group).alias("group_id"), F.lit(name).alias("topic"), "topic_partition", "committed", F.lit(now + keep).cast("long").alias("expires"))
        rows.withColumn("slot", md5_mod(F.col("group_id"), SLOTS)).coalesce(1).write.mode("append").partitionBy("slot").parquet(f"{self.base}/offsets")

    def committed(self, group: str, name: str, now: int) -> DataFrame:
        rows = self._table("offsets", COMMITS).where((F.col("slot") == md5_mod(F.lit(group), SLOTS)) & (F.col("group_id") == group) & (F.col("topic") == name))
        return offset_ops.current(rows, now).select("topic_partition", "committed")
