"""Assignment of partitions to the members of a consumer group.

Members and topics of a group are few; the plans still join and number, so any number works.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.fold import ordered_fold, shared_cursor
from tidelog.operators.topics import numbered


def range_assignment(subscriptions: DataFrame, topics: DataFrame) -> DataFrame:
    """Per topic: members in order get runs of n // m partitions, the first n % m of them one more.

    subscriptions: member, topic; topics: topic, partitions.
    """
    ranked = subscriptions.withColumns({
        "r": F.row_number().over(W.partitionBy("topic").orderBy("member")) - 1,
        "m": F.count("*").over(W.partitionBy("topic")),
    }).join(topics, "topic")
    q, x = F.floor(F.col("partitions") / F.col("m")), F.col("partitions") % F.col("m")
    start = F.col("r") * q + F.least("r", x)
    length = q + F.when(F.col("r") < x, 1).otherwise(0)
    held = ranked.withColumns({"start": start, "length": length}).where("length > 0")
    return held.select("topic", "member", F.explode(F.sequence(F.col("start").cast("int"), (F.col("start") + F.col("length") - 1).cast("int"))).alias("partition"))


def every_partition(topics: DataFrame) -> DataFrame:
    return topics.where("partitions > 0").select("topic", F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)).alias("partition"))


def _members(subscriptions: DataFrame) -> DataFrame:
    """member and its number among all in order; no task numbers more than those whose names begin alike."""
    return numbered(subscriptions.select("member").distinct(), ["member"], "number", (), F.substring("member", 1, 4))


def round_robin_assignment(subscriptions: DataFrame, topics: DataFrame) -> DataFrame:
    """All partitions in order, in turn over all members; a turn that falls on a member without the topic leaves it unassigned.

    A partition's number is its own plus the partitions of the topics before, so nothing is numbered row by row.
    """
    begins = topics.withColumn("begin", F.sum("partitions").over(W.orderBy("topic")) - F.col("partitions"))  # a row a topic
    members = _members(subscriptions)
    count = members.agg(F.count("*").alias("members"))
    turns = every_partition(topics).join(begins.select("topic", "begin"), "topic").join(F.broadcast(count))  # one row
    turns = turns.withColumn("number", (F.col("begin") + F.col("partition")) % F.col("members")).join(members, "number", "left")
    held = turns.join(subscriptions.select("topic", "member", F.lit(True).alias("has")), ["topic", "member"], "left")
    return held.select("topic", "partition", F.when(F.col("has"), F.col("member")).alias("member"))


def sticky_assignment(subscriptions: DataFrame, topics: DataFrame, previous: DataFrame) -> DataFrame:
    """Valid previous owners stay (the first member wins); the rest go in turn, past members without the topic.

    Within a topic the turn goes round its subscribers, so only where each topic begins depends on the topics before:
    one row a topic is folded, and the partitions are joined with its subscribers by their places.
    """
    every = every_partition(topics)
    valid = previous.join(subscriptions, ["topic", "member"]).groupBy("topic", "partition").agg(F.min("member").alias("member"))
    kept = every.join(valid, ["topic", "partition"])
    rest = numbered(every.join(valid, ["topic", "partition"], "left_anti"), ["partition"], "nth", ("topic",))
    members = _members(subscriptions)
    of = subscriptions.join(members, "member")
    turns = rest.groupBy("topic").agg(F.count("*").alias("left")).join(of.groupBy("topic").agg(F.array_sort(F.collect_list("number")).alias("numbers")), "topic", "left")
    rows = turns.join(F.broadcast(members.agg(F.count("*").alias("members"))))  # one row
    begins = ordered_fold(rows.withColumn("one", F.lit(0)), ["one"], ["topic"], ["numbers", "left", "members"], *shared_cursor(), "first long")
    dealt = rest.join(begins.select("topic", "first", F.size("numbers").alias("many")), "topic")
    dealt = dealt.withColumn("place", F.when(F.col("many") > 0, (F.col("first") + F.col("nth")) % F.col("many")))
    placed = numbered(of, ["number"], "place", ("topic",)).select("topic", "place", "member")
    dealt = dealt.join(placed, ["topic", "place"], "left")
    return kept.select("topic", "partition", "member", F.lit(True).alias("kept")).union(dealt.select("topic", "partition", "member", F.lit(False)))


def handed_over(old: DataFrame, new: DataFrame) -> DataFrame:
    """What members give up and get between two assignments (topic, partition, member); nobody's partitions take no part."""
    by = ["topic", "partition", "member"]
    old, new = (x.where("member IS NOT NULL").select(*by) for x in (old, new))
    return old.join(new, by, "left_anti").withColumn("step", F.lit("revoke")).union(new.join(old, by, "left_anti").withColumn("step", F.lit("assign")))


STRATEGIES = {"range": range_assignment, "roundrobin": round_robin_assignment, "sticky": sticky_assignment}


def strategy(name: str):
    """An assignment strategy by name; `sticky` also takes the previous assignment."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES[name]
