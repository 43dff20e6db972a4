"""Replicas, leaders, votes and reassignments as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BY = ("partition",)


def placement(partition: Column, brokers: int, replicas: int) -> Column:
    """(p + i) modulo the brokers, each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(replicas - 1)), lambda i: ((partition + i) % brokers).cast("int")))


def live_placement(live: Column, replicas: Column) -> Column:
    """The first live brokers, or none if there are too few of them; `live` is in order."""
    return F.when(F.size(live) >= replicas, F.slice(live, F.lit(1), replicas)).otherwise(F.slice(live, 1, 0))


def in_sync(replicas: DataFrame, most: int = 10) -> DataFrame:
    """Replica rows (partition, broker, leo, is_leader) with the leader's log end, the lag and whether each is in sync."""
    end = F.max(F.when(F.col("is_leader"), F.col("leo"))).over(W.partitionBy(*BY))
    rows = replicas.withColumn("leader_leo", end).withColumn("lag", F.col("leader_leo") - F.col("leo"))
    return rows.withColumn("in_sync", F.col("is_leader") | F.coalesce(F.col("lag") <= most, F.lit(False)))


def high_watermark(rows: DataFrame) -> DataFrame:
    """The least log end of those in sync, and how many they are."""
    return rows.groupBy(*BY).agg(F.min(F.when(F.col("in_sync"), F.col("leo"))).alias("high_watermark"), F.sum(F.col("in_sync").cast("int")).cast("long").alias("isr"), F.count("*").alias("replicas"))


def ack(acks: Column, has_leader: Column, isr: Column, min_isr: int, high: Column, target: Column) -> Column:
    """OK, or the numbered error: 1 unknown partition, 2 timeout, 3 not leader, 4 too few in sync."""
    return (
        F.when(isr.isNull(), 1)
        .when(acks.isin(0, 1), F.when(has_leader, 0).otherwise(3))
        .when(~has_leader, 3)
        .when(isr < min_isr, 4)
        .when(high >= target, 0)
        .otherwise(2)
        .cast("int")
    )


def elect(isr: Column, replicas: Column, live: Column, unclean: bool) -> Column:
    """The first live broker in sync, else (if unclean elections are allowed) the first live replica, else null."""
    clean = F.filter(isr, lambda b: F.array_contains(live, b))
    dirty = F.filter(replicas, lambda b: F.array_contains(live, b))
    return F.coalesce(F.get(clean, F.lit(0)), F.get(dirty, F.lit(0)) if unclean else F.lit(None).cast("int"))


def commit_index(matches: DataFrame, by: str, term: int) -> DataFrame:
    """The largest index that a majority holds, if its entry is of the current term.

    matches: by, node, match_index, entry_term (the term of the entry at match_index).
    """
    found = matches.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("match_index", "entry_term"))).alias("m"))
    at = F.col("m")[F.floor((F.size("m") - 1) / 2).cast("int")]
    return found.select(by, at["match_index"].alias("candidate"), F.when(at["entry_term"] == term, at["match_index"]).alias("commit_index"))


def epoch_filter(updates: DataFrame, by: list[str], order: str) -> DataFrame:
    """Updates whose epoch is not below one seen before for the cluster; the latest of each key."""
    highest = F.max("epoch").over(W.partitionBy("cluster").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    fresh = updates.withColumn("_highest", highest).where(F.col("epoch") >= F.col("_highest"))
    return fresh.groupBy(*by).agg(F.max_by(F.struct("epoch", "leader"), order).alias("last")).select(*by, "last.epoch", "last.leader")


def log_conflict(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """The follower's log after an append: its prefix up to the first index where terms differ, then the leader's."""
    both = leader.withColumnRenamed("term", "leader_term").join(follower.withColumnRenamed("term", "follower_term"), ["node", "index"], "full_outer")
    differs = F.min(F.when(F.col("leader_term").isNotNull() & F.col("follower_term").isNotNull() & (F.col("leader_term") != F.col("follower_term")), F.col("index"))).over(W.partitionBy("node"))
    rows = both.withColumn("first_conflict", differs)
    kept = F.col("follower_term").isNotNull() & (F.col("first_conflict").isNull() | (F.col("index") < F.col("first_conflict")))
    out = rows.select("node", "index", F.when(kept, F.col("follower_term")).otherwise(F.col("leader_term")).alias("term"), F.when(kept, "kept").otherwise("appended").alias("from"))
    return out.where(F.col("term").isNotNull())
