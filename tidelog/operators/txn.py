"""Transactions: what a reader may see, the latest states, recovery, and which steps are legal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The states that may follow each state.
FOLLOWS = {
    "EMPTY": ("ONGOING",),
    "ONGOING": ("PREPARE_COMMIT", "PREPARE_ABORT"),
    "PREPARE_COMMIT": ("COMMITTED",),
    "PREPARE_ABORT": ("ABORTED",),
    "COMMITTED": (),
    "ABORTED": (),
}


def _dealt() -> Column:
    """The transaction, or for records without one a text that no transaction is called and that few records share."""
    return F.coalesce(F.col("transaction_id"), F.concat(F.lit("\0"), (F.col("offset") % 65536).cast("string")))


def read_committed(topic: DataFrame, apart: bool = False, markers: DataFrame | None = None) -> DataFrame:
    """Without markers and without records whose transaction was aborted by an earlier marker; no transaction, never hidden.

    A reader remembers aborted transactions over all partitions, which it drains in order, so earlier is before by
    (partition, offset). With `apart` each partition has its own reader, and earlier is before in the same partition.
    Markers are reduced to the first of each transaction before they meet the records; `markers` (partition, offset,
    transaction_id, marker) says where they are, if not in `topic` (the log that `topic` was made from, say).
    """
    log = topic if markers is None else markers
    place = F.struct("partition", "offset")
    by = [_dealt().alias("_dealt"), *([F.col("partition").alias("_partition")] if apart else [])]
    aborts = log.where((F.col("marker") == "ABORT") & F.col("transaction_id").isNotNull()).groupBy(*by).agg(F.min(place).alias("_abort"))
    rows = topic.where(F.col("marker").isNull()).select("*", *by)
    shown = rows.join(aborts, ["_dealt", *(["_partition"] if apart else [])], "left")
    return shown.where(F.col("_abort").isNull() | (place < F.col("_abort"))).select(*topic.columns)


def read_committed_lso(topic: DataFrame) -> DataFrame:
    """Without markers, records of a transaction with an ABORT marker anywhere, and records after its last marker in their partition (still open)."""
    marks = topic.where(F.col("marker").isNotNull() & F.col("transaction_id").isNotNull())
    ends = marks.groupBy("partition", "transaction_id").agg(F.max("offset").alias("_end"), F.max(F.col("marker") == "ABORT").alias("_aborted"))
    # One row for each partition of a transaction from here on.
    over = ends.groupBy("transaction_id").agg(F.max("_aborted").alias("_aborted"), F.collect_list(F.struct("partition", "_end")).alias("_ends"))
    ended = over.where(~F.col("_aborted")).select(F.col("transaction_id").alias("_dealt"), F.explode("_ends").alias("_x")).select("_dealt", F.col("_x.partition").alias("_partition"), F.col("_x._end").alias("_end"))
    rows = topic.where(F.col("marker").isNull()).withColumn("_dealt", _dealt())
    rows = rows.join(ended, (rows["_dealt"] == ended["_dealt"]) & (rows["partition"] == ended["_partition"]), "left").drop("_dealt", "_partition")
    return rows.where(F.col("transaction_id").isNull() | (F.col("offset") < F.col("_end"))).drop("_end")


def latest(states: DataFrame) -> DataFrame:
    return states.groupBy("transaction_id").agg(F.max_by(F.struct("state", "since"), "seq").alias("last")).select("transaction_id", "last.state", "last.since")


def recovery(found: DataFrame, now: int, most: int) -> DataFrame:
    """What a restarted coordinator does with each transaction."""
    action = (
        F.when(F.col("state") == "PREPARE_COMMIT", "COMMIT")
        .when(F.col("state") == "PREPARE_ABORT", "ABORT")
        .when(~F.col("state").isin("COMMITTED", "ABORTED") & (now - F.col("since") > most), "ABORT")
        .otherwise("LEAVE")
    )
    return found.withColumn("action", action)


def legal(before: Column, after: Column) -> Column:
    return F.concat_ws(">", F.coalesce(before, F.lit("EMPTY")), after).isin([f"{a}>{b}" for a, bs in FOLLOWS.items() for b in bs])


def illegal_steps(states: DataFrame) -> DataFrame:
    before = F.lag("state").over(W.partitionBy("transaction_id").orderBy("seq"))
    return states.withColumn("before", F.coalesce(before, F.lit("EMPTY"))).where(~legal(F.col("before"), F.col("state")))
