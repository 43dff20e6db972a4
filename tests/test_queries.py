"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tidelog.plans import all_oracles, all_queries


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(frame: pd.DataFrame) -> list[str]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return None
        if isinstance(x, (float, np.floating)):
            x = round(float(x), 6)
            return int(x) if x.is_integer() else x  # a column with nulls comes as floats
        x = x.item() if isinstance(x, np.generic) else x
        return int(x) if isinstance(x, bool) else x

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(map(plain, r))) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_same_rows_as_sql(spark, duck, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    if name in all_oracles():
        want = duck.sql(all_oracles()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_archive_holds_the_package():
    import zipfile

    names = zipfile.ZipFile(entry._packed()).namelist()
    assert "tidelog/plans/logs.py" in names and "tidelog/__init__.py" in names and not any(n.startswith("tests") for n in names)


def plan_of(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_reads_of_topics_are_scans(spark):
    """A lookup shuffles nothing; partitions and offsets reach the scan."""
    from tidelog.plans import stored

    stored.events(spark, SMALL)
    plan = plan_of(entry.queries()["point_lookup"](spark, SMALL))
    assert "Exchange" not in plan and "EqualTo(offset,42)" in plan
    plan = plan_of(entry.queries()["topic_read"](spark, SMALL))
    assert "Exchange" not in plan and "GreaterThanOrEqual(offset,100)" in plan and "partition#" in plan.split("PartitionFilters")[1][:60]
    plan = plan_of(entry.queries()["fetch_batch"](spark, SMALL))
    assert "LessThan(offset" in plan


def test_stored_topics_follow_their_table(spark, tmp_path):
    from tidelog.operators import topics
    from tidelog.plans import stored

    rows = spark.read.parquet(f"{SMALL}/events.parquet")
    for n in (100, 60):
        rows.limit(n).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        got, want = stored.events(spark, str(tmp_path)), topics.events_topic(spark, str(tmp_path))
        assert got.dtypes == want.dtypes and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == n


def test_floor_lookups_over_stretches(spark, monkeypatch):
    from tidelog.operators import storage

    monkeypatch.setattr(storage, "STRETCH", 10)
    entries = spark.createDataFrame([("a", o, 100 * o) for o in (3, 4, 47, 81)] + [("b", 25, 1)], "source string, offset long, position long")
    probes = spark.createDataFrame([(s, o) for s in "abc" for o in range(0, 100, 3)], "source string, offset long")
    got = {(r.source, r.offset): (r.rel_offset, r.position) for r in storage.floor_lookup(entries, probes, "source").collect()}
    for s, at in (("a", (3, 4, 47, 81)), ("b", (25,)), ("c", ())):
        for o in range(0, 100, 3):
            last = max((x for x in at if x <= o), default=None)
            assert got[s, o] == ((None, None) if last is None else (last, 100 * last if s == "a" else 1))


def test_offset_filters_reach_the_scan(spark):
    plan = entry.queries()["consumer_lag"](spark, SMALL)._jdf.queryExecution().toString()
    assert "o_totalprice" not in plan.split("== Physical Plan ==")[1]
