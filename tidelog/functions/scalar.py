"""Sizes, times, names and small decisions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.routing import md5_mod

#: Bytes of a frame besides its key and value.
FRAME = 26
#: The estimated part of a value that a codec leaves, and phrases of errors worth another try.
CODEC_PARTS = {"none": 1.0, "gzip": 0.3, "snappy": 0.5, "lz4": 0.6}
RETRYABLE = ("timeout", "connection refused", "connection reset", "broken pipe", "temporarily unavailable", "service unavailable")


def octets(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def frame_size(key: Column, value: Column) -> Column:
    return (octets(key) + octets(value) + FRAME).cast("long")


def compressed_estimate(size: Column, codec: str) -> Column:
    if codec not in CODEC_PARTS:
        raise ValueError(f"unknown codec {codec!r}")
    return F.floor(size * F.lit(CODEC_PARTS[codec])).cast("long")


def worth_compressing(size: Column, least: int = 1024) -> Column:
    return size >= least


def backoff_ms(base: Column, attempt: Column, most: int = 32000) -> Column:
    """Without jitter, so that it is repeatable."""
    return F.least(base * F.pow(F.lit(2), attempt), F.lit(most)).cast("long")


def jittered_ms(base: Column, attempt: Column, number: Column, seed: int = 0, most: int = 32000, jitter: int = 20) -> Column:
    """The wait and 0 to `jitter` ms by a number and a seed, so that a task that runs again waits as long."""
    return backoff_ms(base, attempt, most) + md5_mod(F.concat(number.cast("string"), F.lit(f":{seed}")), jitter + 1)


def retryable(message: Column, kind: Column | None = None) -> Column:
    """By the kind of error if it is one of two (`RetryableError`, `NonRetryableError`), else by phrases of its message."""
    by_phrase = F.coalesce(F.lower(message).rlike("|".join(RETRYABLE)), F.lit(False))
    return by_phrase if kind is None else F.when(kind == "RetryableError", True).when(kind == "NonRetryableError", False).otherwise(by_phrase)


def file_name(base_offset: Column, suffix: str = ".log") -> Column:
    return F.concat(F.lpad(base_offset.cast("string"), 20, "0"), F.lit(suffix))


def transfer_method(size: Column, tls: Column, platform: str = "linux") -> Column:
    kib = 1024
    send = F.lit(platform == "linux") & (size > 64 * kib)
    return F.when(tls, "standard").when(send, "sendfile").when((size >= 4 * kib) & (size <= 100 * kib * kib), "mmap").otherwise("standard")


def size_class(size: Column) -> Column:
    return F.when(size <= 4096, "small").when(size <= 65536, "medium").otherwise("large")


def offset_key(group: Column, topic: Column, partition: Column) -> Column:
    return F.concat_ws(":", group, topic, partition.cast("string"))


def split_offset_key(key: Column) -> Column:
    """group, topic and partition; an error unless there are three parts."""
    parts = F.split(key, ":")
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("group"), parts[1].alias("topic"), parts[2].cast("int").alias("partition"))).otherwise(
        F.raise_error(F.concat(F.lit("not an offset key: "), key)).cast("struct<group:string,topic:string,partition:int>")
    )


# Times: `now` is always given, so results can be repeated. Which comparison includes the limit differs on purpose.
def batch_due(created: Column, now: Column, linger: int) -> Column:
    return now - created >= linger


def offset_expired(expires: Column, now: Column) -> Column:
    return now > expires


def producer_expired(last: Column, now: Column, most: int) -> Column:
    return now - last > most


def member_expired(heartbeat: Column, now: Column, session: int) -> Column:
    return now - heartbeat > session


def timed_out(state: Column, started: Column, now: Column, most: int) -> Column:
    return ~state.isin("COMMITTED", "ABORTED") & (now - started > most)


def broker_healthy(state: Column, heartbeat: Column, now: Column, most: int) -> Column:
    return state.isin("RUNNING", "STARTING") & (now - heartbeat < most)


def replica_lagging(fetched: Column, now: Column, most: int) -> Column:
    return now - fetched > most


def metadata_stale(loaded: Column, now: Column, most: int) -> Column:
    return now - loaded >= most


def catch_up_progress(lag: Column) -> Column:
    """30 to 60 per cent as the lag falls from 100 to 0."""
    return (30 + F.least(F.lit(30), (30 * (1 - lag / 100.0)).cast("int"))).cast("int")


def eta(elapsed: Column, progress: Column) -> Column:
    return F.when(progress > 0, elapsed * 100.0 / progress - elapsed)


def next_phase(phase: Column, ok: Column) -> Column:
    # The phases in order.
    steps = ("PENDING", "ADDING_REPLICAS", "WAITING_CATCHUP", "REMOVING_REPLICAS", "COMPLETED")
    after = F.create_map(*(F.lit(x) for pair in zip(steps, steps[1:], strict=False) for x in pair))
    return F.when(phase.isin("COMPLETED", "FAILED", "CANCELLED"), phase).when(ok, F.element_at(after, phase)).otherwise("FAILED")
