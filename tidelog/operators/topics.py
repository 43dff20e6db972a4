"""Topics: tables of records (partition, offset, timestamp, key, value) and reads from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.routing import md5_mod
from tidelog.functions.scalar import FRAME, frame_size

PARTITIONS, DAY = 8, 86_400_000
#: Offsets of a partition that are written by one task.
STRETCH = 1 << 20
#: Rows of a key that are folded by one task where its states compose.
FOLDED = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str, frame: DataFrame) -> Column:
    """Milliseconds since 1970, whatever the session's time zone is for a timestamp without one."""
    if dict(frame.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {column})").cast("long")
    return F.unix_millis(column)


def numbered(rows: DataFrame, order: list[str], name: str = "offset", by: tuple[str, ...] = ("partition",), stretch: Column | None = None) -> DataFrame:
    """Dense numbers from 0 for each combination of `by`.

    With a `stretch`, a column that rises with the order (a day, say), no task sees all rows of a
    partition: stretches are numbered inside, and their sizes, one row each, are summed up to say
    where each begins.
    """
    if stretch is None:
        return rows.withColumn(name, (F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    rows = rows.withColumn("_stretch", stretch)
    keys = [*by, "_stretch"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    begins = sizes.select(*keys, (F.sum("_n").over(W.partitionBy(*by).orderBy("_stretch")) - F.col("_n")).alias("_begin"))
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("_inside", inside).join(begins, keys).withColumn(name, (F.col("_begin") + F.col("_inside")).cast("long")).drop("_stretch", "_inside", "_begin")


def globally_numbered(rows: DataFrame, stretch: Column, order: list[str], name: str) -> DataFrame:
    """Dense numbers from 0 over all rows, in stretches."""
    return numbered(rows, order, name, (), stretch)


def stretched(rows: DataFrame, slot: Column, name: str, most: int) -> DataFrame:
    """The number of a stretch for each row, rising with `slot`, a column that rises with the order (a minute, say).

    Whole slots are counted and summed up until there are about `most` rows, so a stretch has less than that and one slot more. A null slot comes first.
    """
    rows = rows.withColumn("_slot", F.coalesce(slot.cast("long"), F.lit(-(1 << 62))))
    sizes = rows.groupBy("_slot").agg(F.count("*").alias("_n"))
    begins = sizes.select("_slot", F.floor((F.sum("_n").over(W.orderBy("_slot")) - F.col("_n")) / most).alias(name))
    return rows.join(begins, "_slot").drop("_slot")


def events_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as a topic, keyed by user; transactions and markers ride along."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        md5_mod(F.col("user_id").cast("string"), PARTITIONS).alias("partition"),
        millis("ts", e).alias("timestamp"),
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("value"),
        "ts", "event_id", "user_id", "event_type",
        F.concat(F.lit("txn-"), F.col("user_id").cast("string")).alias("transaction_id"),
        F.when(F.col("event_type") == "error", "ABORT").when(F.col("event_type") == "signup", "COMMIT").alias("marker"),
    )
    return numbered(rows, ["ts", "event_id"], stretch=F.floor(F.col("timestamp") / DAY))


def write(topic: DataFrame, path: str, mode: str = "error") -> None:
    """A folder for each partition with files that are sorted by offset, so that their statistics do what a sparse index does."""
    dealt = topic.repartition("partition", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("partition", "offset")
    dealt.write.mode(mode).partitionBy("partition").parquet(path)


def read(topic: DataFrame, start: int, most: int = 100) -> DataFrame:
    """At most `most` records of each partition from offset `start` on."""
    found = topic.where(F.col("offset") >= start)
    nth = F.row_number().over(W.partitionBy("partition").orderBy("offset"))
    return found.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")


def fetch(topic: DataFrame, requests: dict[int, tuple[int, int]]) -> DataFrame:
    """The records that fit each request: by partition, an offset to start from and bytes (of frames) at most; `upto` is their sum so far.

    A record has a frame's bytes at least, so each request is also a range of offsets, which reaches the scan.
    """
    wanted = [(F.col("partition") == p) & (F.col("offset") >= start) & (F.col("offset") < start + most // FRAME) for p, (start, most) in requests.items()]
    limit = F.coalesce(*(F.when(F.col("partition") == p, F.lit(most)) for p, (_, most) in requests.items()))
    upto = F.sum(frame_size(F.col("key"), F.col("value"))).over(W.partitionBy("partition").orderBy("offset"))
    rows = topic.where(reduce(lambda a, b: a | b, wanted))
    return rows.withColumn("upto", upto).where(F.col("upto") <= limit)


def list_offsets(topic: DataFrame, at: int) -> DataFrame:
    """The first offset at or after a time in each partition, and the earliest and next ones."""
    return topic.groupBy("partition").agg(
        F.min(F.when(F.col("timestamp") >= at, F.col("offset"))).alias("at_time"), F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("latest")
    )


def stats(topic: DataFrame, segment: int = 100) -> DataFrame:
    return topic.groupBy("partition").agg(
        F.count("*").alias("records"), F.min("offset").alias("first"), F.max("offset").alias("last"), F.countDistinct(F.floor(F.col("offset") / segment)).alias("segments")
    )


def changelog_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a log keyed by customer."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        md5_mod(F.col("o_custkey").cast("string"), PARTITIONS).alias("partition"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value"), "o_orderdate", "o_orderkey"
    )
    return numbered(rows, ["o_orderdate", "o_orderkey"], stretch=F.date_trunc("month", "o_orderdate"))
