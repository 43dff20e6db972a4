"""The store: catalog, appends, transactions, committed offsets; and settings."""

import pytest
from pyspark.sql import functions as F

from tidelog.config import Config
from tidelog.operators import txn
from tidelog.sources.store import Fenced, ProducerConfig, Store, TopicConfig, TransactionalProducer


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_catalog(store):
    assert store.topics().isEmpty()
    store.create("a", 2, TopicConfig(cleanup="compact"))
    with pytest.raises(ValueError):
        store.create("a", 2)
    with pytest.raises(ValueError):
        store.grow("a", 2)
    store.grow("a", 4)
    assert store.describe("a")[:2] == (4, TopicConfig(cleanup="compact"))
    store.delete("a")
    with pytest.raises(KeyError):
        store.describe("a")


def test_appends_continue_and_transactions_end(spark, store):
    store.create("t", 3)
    rows = lambda a, b: spark.createDataFrame([(f"k{i % 5}" if i % 4 else None, f"v{i}", i) for i in range(a, b)], "key string, value string, timestamp long")
    store.append("t", rows(0, 40), ["timestamp"])
    store.append("t", rows(40, 60), ["timestamp"], transaction_id="x")
    store.end_transaction("t", "x", "ABORT")
    store.append("t", rows(60, 70), ["timestamp"], by="round_robin", transaction_id="x")
    got = store.read("t")
    for p in range(3):
        here = sorted(r.offset for r in got.where(f"partition = {p}").collect())
        assert here == list(range(len(here)))
    shown = {r.value for r in txn.read_committed(got, apart=True).collect()}
    assert {f"v{i}" for i in range(60)} <= shown and "" not in shown
    # One reader of all partitions has seen the first marker when it comes to the next partition.
    first = got.where("transaction_id = 'x' and marker is null").agg(F.min("partition")).first()[0]
    assert {(r.partition, r.value) for r in txn.read_committed(got).where("transaction_id = 'x'").collect()} == {(r.partition, r.value) for r in got.where(f"transaction_id = 'x' and marker is null and partition = {first}").collect() if int(r.value[1:]) < 60}
    assert not {f"v{i}" for i in range(60, 70)} & {r.value for r in txn.read_committed(got).where("partition >= 0 and transaction_id = 'x'").collect() if r.value in {f"v{i}" for i in range(60, 70)}}
    assert {r.earliest for r in store.list_offsets("t", 50).collect()} == {0}


def test_committed_offsets(spark, store):
    positions = lambda *rows: spark.createDataFrame(rows, "topic_partition int, committed long")
    store.commit("g", "t", positions((0, 5), (1, 7)), now=0)
    store.commit("g", "t", positions((0, 9), (1, None)), now=1)
    assert [(r.topic_partition, r.committed) for r in store.committed("g", "t", 10).collect()] == [(0, 9)]
    assert store.committed("g", "t", 10**12).isEmpty() and store.committed("h", "t", 0).isEmpty()


def test_rules_and_settings():
    with pytest.raises(ValueError):
        ProducerConfig(acks=1)
    assert ProducerConfig(acks=1, idempotent=False).acks == 1
    c = Config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}, {"TIDELOG_A__C": "7", "TIDELOG_D": "true", "OTHER": "1"})
    assert (c.get("a.b"), c.get("a.c"), c.get("d"), c.get("x.y", 5)) == (3, 7, True, 5)


def test_transactional_producer_and_fencing(spark, store):
    store.create("t", 2)
    rows = lambda a, b: spark.createDataFrame([(f"k{i % 5}", f"v{i}", i) for i in range(a, b)], "key string, value string, timestamp long")
    first = TransactionalProducer(store, "p")
    with pytest.raises(ValueError):
        first.send("t", rows(0, 1), ["timestamp"])
    first.begin()
    with pytest.raises(ValueError):
        first.begin()
    first.send("t", rows(0, 10), ["timestamp"])
    first.commit()
    lost = first.begin()
    first.send("t", rows(10, 20), ["timestamp"])
    first.abort()
    open_ = first.begin()
    first.send("t", rows(20, 30), ["timestamp"])
    second = TransactionalProducer(store, "p")
    assert (first.epoch, second.epoch) == (0, 1) and TransactionalProducer(store, "q").epoch == 0
    for step in (first.commit, first.abort, first.begin):
        with pytest.raises(Fenced):
            step()
    second.begin()
    second.send("t", rows(30, 40), ["timestamp"])
    second.commit()
    got = store.read("t")
    assert {r.value for r in txn.read_committed_lso(got).collect()} == {f"v{i}" for i in (*range(10), *range(30, 40))}
    assert got.where("marker is not null").groupBy("marker").count().count() == 2 and lost != open_


def test_reads_of_a_stored_topic_reach_the_scan(spark, store):
    store.create("t", 4)
    rows = spark.range(4000).select((F.col("id") % 4).cast("int").alias("partition"), F.col("id").cast("string").alias("key"), F.lit("v").alias("value"), F.col("id").alias("timestamp"))
    store.append("t", rows, ["timestamp"])
    found = store.read("t", 100).where("partition = 2 and offset < 120")
    usage = store.usage("t").collect()
    assert sorted(r.partition for r in usage) == [0, 1, 2, 3] and all(r.files >= 1 and r.bytes > 0 for r in usage)
    store.create("empty", 1)
    assert store.usage("empty").isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "GreaterThanOrEqual(offset,100)" in plan and "(partition#" in plan.split("PartitionFilters")[1]
    assert sorted(r.offset for r in found.collect()) == list(range(100, 120))


def test_votes_are_remembered(store):
    assert store.voted("n1") == (0, None)
    store.vote("n1", 3, None)
    store.vote("n1", 3, "n2")
    store.vote("n1", 3, "n2")
    for term, whom in ((3, "n3"), (2, "n2")):
        with pytest.raises(ValueError):
            store.vote("n1", term, whom)
    store.vote("n1", 4, "n3")
    assert store.voted("n1") == (4, "n3")


def test_settings_from_files(tmp_path):
    (tmp_path / "a.json").write_text('{"log": {"bytes": 5}}')
    c = Config.from_file(str(tmp_path / "a.json"), {"log": {"bytes": 1, "age": 2}}, {"TIDELOG_LOG__AGE": "9"})
    assert (c.get("log.bytes"), c.get("log.age")) == (5, 9)
    (tmp_path / "b.json").write_text("[1]")
    with pytest.raises(ValueError):
        Config.from_file(str(tmp_path / "b.json"))
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("log:\n  bytes: 7\n")
    assert Config.from_file(str(tmp_path / "c.yaml"), environment={}).get("log.bytes") == 7
