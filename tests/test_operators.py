"""Operators on small inputs whose results are known."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidelog.functions import routing
from tidelog.operators import cluster, groups, offsets, storage, txn


@pytest.mark.parametrize("n", [1, 3, 7, 8, 50])
def test_md5_mod(spark, n):
    keys = ["", "a", "user-1", "é", "x" * 100]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(routing.md5_mod(F.col("k"), n).alias("p")).collect()
    assert [r.p for r in got] == [int(hashlib.md5(k.encode()).hexdigest(), 16) % n for k in keys]


def test_compaction_of_null_keys_and_of_keyless_partitions(spark):
    log = spark.createDataFrame([(0, 0, "a", "1"), (0, 1, None, "2"), (0, 2, "a", "3"), (0, 3, None, "4"), (1, 0, None, "x"), (1, 1, None, "y")], "partition int, offset long, key string, value string")
    got = sorted((r.partition, r.offset, r.key, r.value) for r in storage.compact(log).collect())
    assert got == [(0, 0, "a", "3"), (0, 1, None, "4"), (1, 0, None, "x"), (1, 1, None, "y")]


def test_range_assignment_of_seven_over_three(spark):
    subs = spark.createDataFrame([(m, "t") for m in "abc"], "member string, topic string")
    got = groups.range_assignment(subs, spark.createDataFrame([("t", 7)], "topic string, partitions int")).groupBy("member").count().collect()
    assert {r.member: r["count"] for r in got} == {"a": 3, "b": 2, "c": 2}


def test_round_robin_leaves_out_what_falls_on_others(spark):
    subs = spark.createDataFrame([("a", "t"), ("b", "u")], "member string, topic string")
    got = groups.round_robin_assignment(subs, spark.createDataFrame([("t", 2), ("u", 2)], "topic string, partitions int")).collect()
    assert {(r.topic, r.partition): r.member for r in got} == {("t", 0): "a", ("t", 1): None, ("u", 0): None, ("u", 1): "b"}


def test_high_watermark_of_those_in_sync(spark):
    rows = cluster.in_sync(spark.createDataFrame([(0, 1, True, 100), (0, 2, False, 95), (0, 3, False, 50)], "partition int, broker int, is_leader boolean, leo long"))
    got = cluster.high_watermark(rows).first()
    assert (got.high_watermark, got.isr) == (95, 2)


def test_deleted_offsets_stay_deleted(spark):
    commits = spark.createDataFrame([("g", 0, 5, 100, 1), ("g", 0, None, 100, 2), ("g", 1, 7, 100, 1)], "group_id string, topic_partition int, committed long, expires long, seq long")
    assert [(r.topic_partition, r.committed) for r in offsets.current(commits, 50).collect()] == [(1, 7)]
    with pytest.raises(ValueError):
        offsets.start_offsets(commits, commits, commits, "other")


def test_isolation_depends_on_order(spark):
    topic = spark.createDataFrame([(0, 0, "t", None), (0, 1, "t", "ABORT"), (0, 2, "t", None), (0, 3, None, None)], "partition int, offset long, transaction_id string, marker string")
    assert sorted(r.offset for r in txn.read_committed(topic).collect()) == [0, 3]
    assert sorted(r.offset for r in txn.read_committed_lso(topic).collect()) == [3]


def test_isolation_of_a_transaction_over_two_partitions(spark):
    rows = [(0, 0, "t", None), (0, 1, "t", "ABORT"), (1, 0, "t", None), (1, 1, "u", None), (1, 2, "u", "COMMIT"), (1, 3, "u", None), (2, 0, "u", None), (2, 1, None, "ABORT"), (2, 2, None, None)]
    topic = spark.createDataFrame(rows, "partition int, offset long, transaction_id string, marker string")
    # The reader drains partition 0 first, so the marker hides what it reads of t in partition 1.
    assert sorted((r.partition, r.offset) for r in txn.read_committed(topic).collect()) == [(0, 0), (1, 1), (1, 3), (2, 0), (2, 2)]
    assert sorted((r.partition, r.offset) for r in txn.read_committed(topic, apart=True).collect()) == [(0, 0), (1, 0), (1, 1), (1, 3), (2, 0), (2, 2)]
    assert sorted((r.partition, r.offset) for r in txn.read_committed_lso(topic).collect()) == [(1, 1), (2, 2)]


def test_isolation_with_hardly_any_transaction(spark):
    """99 of 100 records have none, and they are no single task's."""
    rows = spark.range(50_000).select((F.col("id") % 2).cast("int").alias("partition"), F.floor(F.col("id") / 2).alias("offset"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("transaction_id"))
    topic = rows.withColumn("marker", F.when((F.col("offset") % 500 == 0) & F.col("transaction_id").isNotNull(), "ABORT"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        shown = txn.read_committed(topic)
        each = [r["count"] for r in shown.groupBy(F.spark_partition_id()).count().collect()]
        assert shown.where("transaction_id IS NULL").count() == 49_500 and max(each) < 3 * sum(each) / 16
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", 2)


def test_ended_transactions_go_nowhere(spark):
    steps = ["ONGOING", "PREPARE_COMMIT", "COMMITTED", "ONGOING", "PREPARE_ABORT", "ABORTED", "EMPTY"]
    states = spark.createDataFrame([("t", i, s) for i, s in enumerate(steps)], "transaction_id string, seq long, state string")
    assert sorted((r.before, r.state) for r in txn.illegal_steps(states).collect()) == [("ABORTED", "EMPTY"), ("COMMITTED", "ONGOING")]


def test_sticky_assignment_against_a_plain_loop(spark):
    import random

    rng = random.Random(2)
    for _ in range(4):
        members, names = [f"m{i:02d}" for i in range(rng.randint(1, 12))], [f"t{i}" for i in range(rng.randint(1, 6))]
        subs = sorted({(m, t) for m in members for t in names if rng.random() < 0.5} or {(members[0], names[0])})
        counts = [(t, rng.randint(0, 9)) for t in names]
        before = [(rng.choice(members), rng.choice(names), rng.randint(0, 9)) for _ in range(10)]
        got = groups.sticky_assignment(spark.createDataFrame(subs, "member string, topic string"), spark.createDataFrame(counts, "topic string, partitions int"), spark.createDataFrame(before, "member string, topic string, partition int"))
        known, of = sorted({m for m, _ in subs}), set(subs)
        want, cursor = {}, 0
        for t, n in sorted(counts):
            for p in range(n):
                owners = sorted(m for m, x, q in before if (x, q) == (t, p) and (m, t) in of)
                if owners:
                    want[t, p] = (owners[0], True)
                    continue
                turn = next((i for i in range(len(known)) if (known[(cursor + i) % len(known)], t) in of), None)
                want[t, p] = (None if turn is None else known[(cursor + turn) % len(known)], False)
                cursor = cursor if turn is None else (cursor + turn + 1) % len(known)
        assert {(r.topic, r.partition): (r.member, r.kept) for r in got.collect()} == want
