"""Committed offsets: current state, expiry, reset and lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current(commits: DataFrame, now: int) -> DataFrame:
    """The last commit of each (group, partition), unless it has expired; an empty value deletes."""
    last = commits.groupBy("group_id", "topic_partition").agg(F.max_by(F.struct("committed", "expires"), "seq").alias("last"))
    return last.where(F.col("last.committed").isNotNull() & (F.col("last.expires") >= now)).select("group_id", "topic_partition", F.col("last.committed").alias("committed"))


def fetch_all(commits: DataFrame, now: int) -> DataFrame:
    """As `current`, but commits that have expired are left out before the last is taken."""
    live = commits.where((F.col("expires") >= now) | F.col("committed").isNull())
    last = live.groupBy("group_id", "topic_partition").agg(F.max_by(F.struct("committed"), "seq").alias("last"))
    return last.where(F.col("last.committed").isNotNull()).select("group_id", "topic_partition", F.col("last.committed").alias("committed"))


def active_groups(commits: DataFrame, now: int) -> DataFrame:
    return commits.where((F.col("expires") >= now) & F.col("committed").isNotNull()).select("group_id").distinct()


def deleted(commits: DataFrame, group: str) -> DataFrame:
    """The commits and, for all partitions of a deleted group, an empty one behind them."""
    of = commits.where(F.col("group_id") == group).groupBy("group_id", "topic_partition").agg(F.max("seq").alias("seq"), F.max("expires").alias("expires"))
    return commits.select("group_id", "topic_partition", "committed", "expires", "seq").union(of.select("group_id", "topic_partition", F.lit(None).cast("long"), "expires", F.col("seq") + 1))


def start_offsets(assigned: DataFrame, committed: DataFrame, ends: DataFrame, reset: str, report: bool = False) -> DataFrame:
    """Where each assigned partition starts: its commit, else by the reset strategy (earliest, latest, none).

    With `none` a partition without commit is an error; with `report` it has a null start and is called `error` instead.
    """
    rows = assigned.join(committed, ["group_id", "topic_partition"], "left").join(ends, "topic_partition", "left")
    if reset not in ("earliest", "latest", "none"):
        raise ValueError(f"unknown reset strategy {reset!r}")
    other: Column = {
        "earliest": F.lit(0).cast("long"),
        "latest": F.coalesce(F.col("log_end"), F.lit(-1)).cast("long"),
        "none": F.lit(None).cast("long") if report else F.raise_error(F.lit("no committed offset")).cast("long"),
    }[reset]
    how = F.when(F.col("committed").isNotNull(), "committed").otherwise("error" if reset == "none" else reset)
    return rows.select("group_id", "topic_partition", F.coalesce("committed", other).alias("start"), how.alias("how"))


def lag(committed: DataFrame, ends: DataFrame, partitions: int) -> DataFrame:
    """Log end less commit; null for a partition that the group never committed."""
    groups = committed.select("group_id").distinct()
    every = groups.withColumn("topic_partition", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))))
    rows = every.join(ends, "topic_partition").join(committed, ["group_id", "topic_partition"], "left")
    return rows.select("group_id", "topic_partition", "log_end", "committed", (F.col("log_end") - F.col("committed")).alias("lag"))


def advanced(positions: DataFrame, committed: DataFrame) -> DataFrame:
    """Positions that lie beyond what is committed."""
    rows = positions.join(committed, ["group_id", "topic_partition"], "left")
    return rows.where(F.col("position") > F.coalesce("committed", F.lit(-1))).select("group_id", "topic_partition", "position")
