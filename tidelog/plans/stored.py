"""Topics written once in an application and read by all queries after, as a log is.

A table's topic is made when a query first asks for it, in the folder that executors share, and goes
when the application ends. It is found again by the table's path, size and time of change. Reads of
it are scans: Parquet drops other partitions by their folders and other offsets by statistics, and
nothing is numbered again.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidelog.operators import topics

_KNOWN: dict[tuple, str] = {}
_SCHEMAS: dict[str, StructType] = {}


def _removed(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shared_folder(spark: SparkSession) -> str:
    """Where executors and driver see the same files."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_topics"
    return where.rstrip("/")


def _state(spark: SparkSession, path: str) -> tuple[int, int]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place)
    return found.getLen(), found.getModificationTime()


def temporary(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}"
    atexit.register(_removed, spark, path)
    return path


def made(spark: SparkSession, sf_dir: str, table: str, kind: str, make: Callable[[str], None]) -> str:
    """The place of what `make` has written there for the table as it is now."""
    key = (spark.sparkContext.applicationId, sf_dir, table, kind, *_state(spark, f"{sf_dir}/{table}.parquet"))
    if key not in _KNOWN:
        path = temporary(spark, f"{kind}-{table}-{uuid.uuid4().hex}")
        make(path)
        _KNOWN[key] = path
    return _KNOWN[key]


def _stored(spark: SparkSession, sf_dir: str, table: str, topic: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    def make(path: str) -> None:
        rows = topic(spark, sf_dir)
        topics.write(rows, path)
        _SCHEMAS[path] = rows.schema

    path = made(spark, sf_dir, table, "topic", make)
    schema = _SCHEMAS[path]
    return spark.read.schema(schema).parquet(path).select(*schema.names)  # the partition would come last


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a topic, keyed by user."""
    return _stored(spark, sf_dir, "events", topics.events_topic)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a log keyed by customer."""
    return _stored(spark, sf_dir, "orders", topics.changelog_topic)
