"""Which partition a record goes to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_mod(key: Column, n: int) -> Column:
    """The MD5 sum of a key's bytes, a 128-bit number, modulo n; null for a null key.

    The sum is taken 32 bits at a time, so every step fits a long.
    """
    digest = F.md5(key.cast("binary"))
    rest = F.lit(0).cast("long")
    for i in range(4):
        part = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
        rest = F.pmod(rest * F.lit((1 << 32) % n) + part, F.lit(n))
    return rest.cast("int")


def md5_mod_sql(key: str, n: int) -> str:
    """The same in DuckDB's SQL."""
    rest = "0"
    for i in range(4):
        rest = f"(({rest}) * {(1 << 32) % n} + ('0x' || substr(md5({key}), {1 + 8 * i}, 8))::BIGINT) % {n}"
    return f"CAST({rest} AS INTEGER)"


def default(key: Column, keyless: Column, n: int) -> Column:
    """Keyed records by their key; the others in turn, by their number among the keyless."""
    return F.when(key.isNotNull(), md5_mod(key, n)).otherwise((keyless % n).cast("int"))


def key_hash(key: Column, keyless: Column, n: int) -> Column:
    """By key; a null key is an error."""
    return F.when(key.isNotNull(), md5_mod(key, n)).otherwise(F.raise_error(F.lit("a key is needed")).cast("int"))


def round_robin(key: Column, number: Column, n: int) -> Column:
    """In turn, by the number among all records."""
    return (number % n).cast("int")


def sticky(key: Column, keyless: Column, n: int, run: int = 100) -> Column:
    """Keyed records by key; the others stay for a run and then move on (the first run is one shorter)."""
    return F.when(key.isNotNull(), md5_mod(key, n)).otherwise((F.floor((keyless + 1) / run) % n).cast("int"))


def random(key: Column, number: Column, n: int, seed: int = 0) -> Column:
    """By the record's number and a seed, so that a task that runs again gives what it gave before."""
    return md5_mod(F.concat(number.cast("string"), F.lit(f":{seed}")), n)


PARTITIONERS: dict[str, Callable[..., Column]] = {"default": default, "key_hash": key_hash, "round_robin": round_robin, "random": random, "sticky": sticky}


def partitioner(name: str) -> Callable[..., Column]:
    if name not in PARTITIONERS:
        raise ValueError(f"unknown partitioner {name!r}; there are {', '.join(PARTITIONERS)}")
    return PARTITIONERS[name]
