"""Streaming twins: sequence checks and read-committed over unbounded topics, with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(records: DataFrame, producer: str = "user_id", order: str = "n", seq: str = "seq") -> DataFrame:
    """Records that `sequence_check` accepts, for each producer; others are dropped.

    A micro-batch's records of a producer are taken in `order`; later batches must follow it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order)
        keep = []
        for x in rows[seq].tolist():
            ok = last is None or x == last + 1
            last = x if ok else last
            keep.append(ok)
        state.update((int(last),))
        yield rows[keep]

    return records.groupBy(producer).applyInPandasWithState(step, records.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def read_committed(topic: DataFrame) -> DataFrame:
    """Records whose transaction has had no ABORT marker in their partition so far, and no markers."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        aborted = bool(state.get[0]) if state.exists else False
        rows = pd.concat(list(frames)).sort_values("offset")
        keep = []
        for marker, transaction in zip(rows["marker"], rows["transaction_id"], strict=True):
            keep.append(pd.isna(marker) and not aborted)
            aborted = aborted or (marker == "ABORT" and not pd.isna(transaction))
        state.update((aborted,))
        yield rows[keep]

    # Records without a transaction need no state, and would all be one key's.
    plain = topic.where("transaction_id IS NULL AND marker IS NULL")
    some = topic.where("transaction_id IS NOT NULL").groupBy("partition", "transaction_id")
    return some.applyInPandasWithState(step, topic.schema, "aborted boolean", "append", GroupStateTimeout.NoTimeout).union(plain)


def latest_per_key(changes: DataFrame) -> DataFrame:
    """The compacted view of a changelog, in complete or update mode."""
    from pyspark.sql import functions as F

    return changes.groupBy("partition", "key").agg(F.max_by("value", "offset").alias("value"), F.max("offset").alias("offset"))


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Records in each window of event time; not an operator of logs, offered besides."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("records"))
