"""Producers and groups over time: producer ids with reuse and expiry, last sequences, group generations and fencing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.topics import DAY, globally_numbered

#: Producer ids go round at this number.
WRAP = 1 << 31


def producer_ids(requests: DataFrame, timeout: int, start: int = 0) -> DataFrame:
    """requests (client, at in ms, n, an order among equal times) with `producer_id` and `reused`.

    A client keeps its id while no more than `timeout` ms lie between two requests; otherwise it gets the next one.
    Only new ids are numbered, in stretches of a day; the requests between find theirs as the last of their client.
    """
    order = W.partitionBy("client").orderBy("at", "n")
    before = F.lag("at").over(order)
    marked = requests.withColumn("reused", before.isNotNull() & (F.col("at") - before <= timeout))
    new = globally_numbered(marked.where(~F.col("reused")), F.floor(F.col("at") / DAY), ["at", "n"], "nth")
    new = new.withColumn("producer_id", (F.col("nth") + start) % WRAP).drop("nth")
    rows = new.unionByName(marked.where("reused").withColumn("producer_id", F.lit(None).cast("long")))
    return rows.withColumn("producer_id", F.last("producer_id", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))


def last_sequences(checked: DataFrame, by: list[str]) -> DataFrame:
    """The last accepted sequence number of each producer and partition, and its offset."""
    last = checked.where("verdict = 'ACCEPT'").groupBy(*by).agg(F.max_by(F.struct("seq", "offset"), "n").alias("x"))
    return last.select(*by, F.col("x.seq").alias("last_sequence"), F.col("x.offset").alias("last_offset"))


def duplicates(checked: DataFrame, by: list[str]) -> DataFrame:
    """Each refused repetition with the offset of the record that it repeats, which is its producer's last accepted one."""
    order = W.partitionBy(*by).orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    found = checked.withColumn("of", F.last(F.when(F.col("verdict") == "ACCEPT", F.col("offset")), ignorenulls=True).over(order))
    return found.where("verdict = 'DUPLICATE'")


def generations(log: DataFrame) -> DataFrame:
    """log (group, member, n, kind: join, leave or beat) with the group's `generation` after each row.

    A join of a member that isn't in the group and a leave of one that is begin a new generation.
    """
    own = W.partitionBy("group", "member").orderBy("n")
    was = F.last(F.when(F.col("kind") != "beat", F.col("kind")), ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -1))
    changes = F.when(F.col("kind") == "join", F.coalesce(was != "join", F.lit(True))).when(F.col("kind") == "leave", F.coalesce(was == "join", F.lit(False))).otherwise(F.lit(False))
    rows = log.withColumns({"was_in": F.coalesce(was == "join", F.lit(False)), "changes": changes})
    return rows.withColumn("generation", F.sum(F.col("changes").cast("long")).over(W.partitionBy("group").orderBy("n").rowsBetween(W.unboundedPreceding, 0)))


def fenced(log: DataFrame) -> DataFrame:
    """What each heartbeat gets: a member knows the generation that its last join gave it.

    `unknown` if the member isn't in the group, `fenced` if the group has gone on, else `ok`.
    """
    rows = generations(log)
    own = W.partitionBy("group", "member").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    knows = F.last(F.when(F.col("kind") == "join", F.col("generation")), ignorenulls=True).over(own)
    answer = F.when(~F.col("was_in"), "unknown").when(knows != F.col("generation"), "fenced").otherwise("ok")
    return rows.withColumn("answer", answer).where("kind = 'beat'")


def members(log: DataFrame) -> DataFrame:
    """The members of each group after all rows, with the generation and the leader, who is the first that joined of those."""
    rows = generations(log)
    last = rows.groupBy("group").agg(F.max_by("generation", "n").alias("generation"))
    state = rows.where("kind <> 'beat'").groupBy("group", "member").agg(F.max_by("kind", "n").alias("kind"), F.max(F.when(F.col("changes") & (F.col("kind") == "join"), F.col("n"))).alias("since"))
    inside = state.where("kind = 'join'").join(last, "group")
    first = F.min(F.struct("since", "member")).over(W.partitionBy("group"))
    return inside.select("group", "member", "generation", (first["member"] == F.col("member")).alias("leader"))
