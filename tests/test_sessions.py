"""Producer ids, sequences, groups, throttles and documents against plain loops."""

import random

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tests.conftest import SMALL
from tidelog.functions import documents
from tidelog.operators import fold, sessions, storage, topics
from tidelog.plans import all_queries


def test_producer_ids_expire_and_go_round(spark):
    rng = random.Random(1)
    rows = sorted((rng.choice("abcdef"), rng.randrange(0, 20 * 86_400_000)) for _ in range(300))
    rows = [(c, at, n) for n, (at, c) in enumerate(sorted((at, c) for c, at in rows))]
    timeout, start = 5 * 3_600_000, sessions.WRAP - 20
    last, want, given = {}, {}, start
    for c, at, n in rows:
        if c in last and at - last[c][1] <= timeout:
            last[c] = (last[c][0], at)
            want[n] = (last[c][0], True)
        else:
            last[c] = (given, at)
            want[n] = (given, False)
            given = (given + 1) % sessions.WRAP
    got = sessions.producer_ids(spark.createDataFrame(rows, "client string, at long, n long"), timeout, start).collect()
    assert {r.n: (r.producer_id, r.reused) for r in got} == want and given < 1000 and any(x for _, x in want.values())


def test_groups_and_fencing(spark):
    log = [("join", "a"), ("beat", "a"), ("join", "b"), ("beat", "a"), ("beat", "b"), ("join", "a"), ("beat", "a"), ("leave", "c"), ("leave", "a"), ("beat", "a"), ("beat", "b"), ("join", "b"), ("beat", "b")]
    rows = spark.createDataFrame([("g", m, i, k) for i, (k, m) in enumerate(log)], "group string, member string, n long, kind string")
    assert [r.generation for r in sessions.generations(rows).orderBy("n").collect()] == [1, 1, 2, 2, 2, 2, 2, 2, 3, 3, 3, 3, 3]
    assert [(r.n, r.answer) for r in sessions.fenced(rows).orderBy("n").collect()] == [(1, "ok"), (3, "fenced"), (4, "ok"), (6, "ok"), (9, "unknown"), (10, "fenced"), (12, "ok")]
    assert [(r.member, r.generation, r.leader) for r in sessions.members(rows).collect()] == [("b", 3, True)]


def test_two_throttles_hold_a_stretch_in_a_task(spark, monkeypatch):
    want = {(r.event_id, r.partition, r.global_goes, r.goes) for r in all_queries()["throttle_two_level"](spark, SMALL).collect()}
    monkeypatch.setattr(topics, "FOLDED", 50, raising=False)
    sizes, dealt = [], DataFrame.mapInArrow

    def counted(rows, *args, **kw):
        sizes.append(rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return dealt(rows, *args, **kw)

    monkeypatch.setattr(DataFrame, "mapInArrow", counted)
    got = all_queries()["throttle_two_level"](spark, SMALL)
    assert len(sizes) >= 2 and max(sizes) <= 100
    assert {(r.event_id, r.partition, r.global_goes, r.goes) for r in got.collect()} == want and len(want) > 900


def test_a_request_without_size_or_time_is_an_error(spark):
    for at, size in (("CAST(NULL AS long)", "1L"), ("id", "CAST(NULL AS long)")):
        rows = spark.range(3).selectExpr("id", "0L AS stretch", f"{at} AS at", f"{size} AS size")
        with pytest.raises(PythonException):
            fold.stretched_bucket(rows, [], "stretch", ["id"], ("at", "size"), 10, "goes", 1)


def test_two_throttles_against_a_plain_loop(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.round(F.col("value") * 100).cast("long").alias("bytes")).orderBy("ms", "event_id").collect()
    step_all, step_one = fold.token_bucket(20_000)[1], fold.token_bucket(5000)[1]
    state, first = (0, None), []
    for e in events:
        state, (goes,) = step_all(state, (e.ms, e.bytes))
        if goes is not None:
            first.append((goes, e.event_id, e.user_id % 8, e.bytes))
    states, want = {}, {}
    for goes, event, part, size in sorted(first):
        states[part], (last,) = step_one(states.get(part, (0, None)), (goes, size))
        want[event] = (goes, last)
    got = all_queries()["throttle_two_level"](spark, SMALL).collect()
    assert {r.event_id: (r.global_goes, r.goes) for r in got} == want


def test_rotation_by_size_and_age():
    state, step = fold.rotation(10, 100)
    out = []
    for value in [(6, 0), (6, 1), (1, 2), (1, 100), (1, 102), (50, 103), (1, 104)]:
        state, got = step(state, value)
        out.append(got[0])
    assert out == [0, 0, 1, 1, 2, 2, 3]


def test_documents_and_their_defaults(spark):
    one = spark.range(1)
    text = one.select(documents.to_json("offset_value", F.struct(F.lit(5), F.lit("m"), F.lit(1), F.lit(2))).alias("j")).first().j
    assert text == '{"offset":5,"metadata":"m","commit_timestamp":1,"expire_timestamp":2}'
    got = one.select(documents.from_json("broker", F.lit('{"broker_id": 3, "host": "h", "port": 1}')).alias("x"), documents.from_json("vote", F.lit('{"current_term": 2, "voted_for": null}')).alias("v")).first()
    assert (got.x.broker_id, got.x.state, got.x.last_heartbeat, got.x.rack) == (3, "starting", 0, None) and (got.v.current_term, got.v.voted_for) == (2, None)
    with pytest.raises(ValueError):
        documents.to_json("other", F.lit(1))


def test_index_recovery_and_pruning(spark):
    entries = spark.createDataFrame([(s, i, 10 * i) for s in "ab" for i in range(20)], "source string, offset long, position long")
    # Damage behind the first ten isn't looked at.
    stored = entries.withColumn("position", F.when((F.col("source") == "a") & (F.col("offset") == 3), 1).when((F.col("source") == "b") & (F.col("offset") == 15), 1).otherwise(F.col("position")))
    got = storage.index_recovered(stored, entries, "source").collect()
    assert len(got) == 40 and {r.source: r.kept for r in got} == {"a": False, "b": True}
    assert {(r.source, r.offset): r.position for r in got} == {("a", i): 10 * i for i in range(20)} | {("b", i): 1 if i == 15 else 10 * i for i in range(20)}
    found = spark.createDataFrame([(0, b) for b in (0, 100, 200)], "partition int, base_offset long")
    assert [sorted(r.base_offset for r in storage.pruned(found, n).collect()) for n in (0, 99, 100, 500)] == [[0, 100, 200], [0, 100, 200], [100, 200], [200]]
