"""Compaction, retention, segments and the sparse index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.topics import numbered

#: Offsets of a log that are numbered in one go.
STRETCH = 1 << 20


def compact(log: DataFrame, preserve_offsets: bool = False) -> DataFrame:
    """The latest record of each key; null keys are one key. Survivors stand in the order of their key's first record.

    New offsets are dense unless the old ones are kept. A partition without any key is left alone.
    """
    latest = log.groupBy("partition", "key").agg(F.min("offset").alias("first"), F.max_by(F.struct("offset", "value"), "offset").alias("last"))
    # One row a key from here on; partitions without keys are found among those.
    keyed = latest.where(F.col("key").isNotNull()).select("partition").distinct()
    if preserve_offsets:
        kept = latest.select("partition", "key", F.col("last.offset").alias("offset"), F.col("last.value").alias("value"))
    else:
        rows = latest.select("partition", "key", "first", F.col("last.value").alias("value"))
        kept = numbered(rows, ["first"], stretch=F.floor(F.col("first") / STRETCH)).select("partition", "key", "offset", "value")
    bare = log.join(keyed, "partition", "left_anti").select("partition", "key", "offset", "value")
    return kept.join(keyed, "partition", "left_semi").select("partition", "key", "offset", "value").union(bare)


def compaction_gate(log: DataFrame, least: float = 0.5) -> DataFrame:
    """Which partitions are worth compacting: the share of records that repeat a key reaches `least`, and some have keys."""
    per_key = log.groupBy("partition", "key").agg(F.count("*").alias("n"))
    sums = per_key.groupBy("partition").agg(F.sum("n").alias("records"), F.count("*").alias("keys"), F.max(F.col("key").isNotNull()).alias("keyed"))
    ratio = 1 - F.col("keys") / F.col("records")
    return sums.select("partition", "records", "keys", F.round(ratio, 6).alias("ratio"), (F.col("keyed") & (ratio >= least)).alias("compacts"))


def segments(topic: DataFrame, records: int = 100) -> DataFrame:
    """Segments of a fixed number of records, with size and age; the last of a partition is active."""
    size = F.octet_length("key") + F.octet_length("value") + 26
    found = topic.groupBy("partition", F.floor(F.col("offset") / records).alias("segment")).agg(
        F.min("offset").alias("base_offset"), F.sum(size).alias("size"), F.max("timestamp").alias("last_ts")
    )
    return found.withColumn("active", F.col("segment") == F.max("segment").over(W.partitionBy("partition")))


def retention(found: DataFrame, now: int, hours: float | None = None, limit: int | None = None) -> DataFrame:
    """Segments with `delete`: closed ones older than `hours`, and the oldest ones of a log larger than `limit` bytes."""
    delete = F.lit(False)
    if hours is not None:
        delete = delete | (~F.col("active") & (now - F.col("last_ts") > int(hours * 3_600_000)))
    if limit is not None:
        closed = F.when(F.col("active"), F.lit(0)).otherwise(F.col("size"))
        before = F.coalesce(F.sum(closed).over(W.partitionBy("partition").orderBy("base_offset").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        total = F.sum("size").over(W.partitionBy("partition"))
        delete = delete | (~F.col("active") & (before < total - limit))
    return found.withColumn("delete", delete)


def floor_lookup(entries: DataFrame, probes: DataFrame, by: str) -> DataFrame:
    """For each probe the last entry at or before its offset: an as-of join by union and a running last value.

    The values run inside stretches of offsets; where a stretch begins, the last entry of those before it stands, of
    which there is one a stretch. So no task sees a whole log.
    """
    left = entries.select(by, F.col("offset").alias("at"), F.lit(0).alias("probe"), F.struct(F.col("offset").alias("rel_offset"), "position").alias("entry"))
    right = probes.select(by, F.col("offset").alias("at"), F.lit(1).alias("probe"), F.lit(None).cast(left.schema["entry"].dataType).alias("entry"))
    rows = left.union(right).withColumn("_stretch", F.floor(F.col("at") / STRETCH))
    inside = F.last("entry", ignorenulls=True).over(W.partitionBy(by, "_stretch").orderBy("at", "probe").rowsBetween(W.unboundedPreceding, 0))
    ends = rows.groupBy(by, "_stretch").agg(F.max_by("entry", F.when(F.col("entry").isNotNull(), F.col("at"))).alias("end"))
    before = F.last("end", ignorenulls=True).over(W.partitionBy(by).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1))
    begins = ends.select(by, "_stretch", before.alias("begin"))
    found = rows.withColumn("entry", inside).where("probe = 1").join(begins, [by, "_stretch"]).withColumn("entry", F.coalesce("entry", "begin"))
    return found.select(by, F.col("at").alias("offset"), F.col("entry.rel_offset").alias("rel_offset"), F.col("entry.position").alias("position"))


def index_differences(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Entries of a stored index that a rebuild doesn't have, and the other way round."""
    return stored.exceptAll(rebuilt).withColumn("side", F.lit("stored")).union(rebuilt.exceptAll(stored).withColumn("side", F.lit("rebuilt")))


def index_truncated(entries: DataFrame, ends: DataFrame, by: str) -> DataFrame:
    """Entries below where each log has been cut (`end`)."""
    return entries.join(ends, by).where(F.col("offset") < F.col("end")).drop("end")


def index_recovered(stored: DataFrame, rebuilt: DataFrame, by: str, looked_at: int = 10) -> DataFrame:
    """Stored entries of the logs whose first `looked_at` are those of a rebuild, and rebuilt ones of the others; `kept` says which."""
    nth = F.row_number().over(W.partitionBy(by).orderBy("offset"))
    first = lambda x: x.select(by, "offset", "position", nth.alias("nth")).where(F.col("nth") <= looked_at)
    both = first(stored).join(first(rebuilt).select(by, "nth", F.col("offset").alias("o"), F.col("position").alias("p"), F.lit(1).alias("has")), [by, "nth"], "left")
    wrong = both.groupBy(by).agg(F.max(~((F.col("offset") == F.col("o")) & (F.col("position") == F.col("p")) & F.col("has").isNotNull())).alias("x"), F.count("*").alias("n"))
    bad = wrong.where(F.coalesce("x", F.lit(True))).select(by)
    known = stored.select(by).distinct()
    kept = stored.join(bad, by, "left_anti").withColumn("kept", F.lit(True))
    again = rebuilt.join(known.join(bad, by, "left_anti"), by, "left_anti").withColumn("kept", F.lit(False))
    return kept.unionByName(again)


def pruned(found: DataFrame, start: int) -> DataFrame:
    """Segments that hold offset `start` or a later one: the next of the log begins after it, or there is none."""
    following = F.lead("base_offset").over(W.partitionBy("partition").orderBy("base_offset"))
    return found.withColumn("next_offset", following).where(F.col("next_offset").isNull() | (F.col("next_offset") > start))
