"""Streams give what the batch operators give."""

import pytest

from tests.conftest import SMALL
from tidelog.operators import fold, txn
from tidelog.plans import state
from tidelog.streaming import stateful


@pytest.fixture
def replay(spark, tmp_path):
    def run(rows, order, transform, mode="append", files=4):
        path = str(tmp_path / "in")
        rows = rows.orderBy(*order).toPandas()
        size = -(-len(rows) // files)
        for i in range(files):
            spark.createDataFrame(rows.iloc[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        name = f"out_{abs(hash(str(tmp_path)))}"
        q = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        return spark.table(name)

    schema = None

    def with_schema(rows, *a, **k):
        nonlocal schema
        schema = rows.schema
        return run(rows, *a, **k)

    return with_schema


def same(a, b):
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_sequences(spark, replay):
    rows = state.sequences(spark, SMALL).select("user_id", "event_id", "n", "seq")
    want = fold.ordered_fold(rows, ["user_id"], ["n"], ["seq"], *fold.sequence_check(), "verdict string").where("verdict = 'ACCEPT'").drop("verdict")
    same(replay(rows, ["event_id"], stateful.deduplicated), want)


def test_read_committed(spark, replay):
    from tidelog.operators.topics import events_topic

    rows = events_topic(spark, SMALL).select("partition", "offset", "key", "value", "marker", "transaction_id")
    same(replay(rows, ["offset"], stateful.read_committed), txn.read_committed(rows))


def test_latest_per_key(spark, replay):
    from tidelog.operators.storage import compact
    from tidelog.operators.topics import changelog_topic

    rows = changelog_topic(spark, SMALL).select("partition", "offset", "key", "value")
    got = replay(rows, ["offset"], stateful.latest_per_key, "complete").select("partition", "key", "offset", "value")
    same(got, compact(rows, preserve_offsets=True))
