"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard's score for a key is -weight / ln(u), where u in (0, 1) comes from a hash of the key and
the shard's number; the highest score wins. With one more shard a key either stays where it is or
goes to the new one. Only SQL functions are used.

Slots number the rows of a shard from 0 without gaps. A shard is cut into BUCKETS parts by a hash
of the key; parts are numbered inside, and part sizes (BUCKETS times the shards, a fixed number)
are summed up to say where each part begins, so no task holds a shard. Rows alike in key, size and
checksum are counted first and numbered as one block, so a row repeated any number of times does
not gather in a task either.

Defined results: a null key hashes as its own value; a null text has size 1 and the checksum of no
bytes; repeated rows each get a row and a slot, in one shard; slots among rows of one part go by
key (null first), checksum and size; an empty table gives no rows; of a text of any length only the
size and the checksum travel. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.tables import table

SHARDS, BUCKETS, BLOCK = 16, 256, 4096


def unit(key: Column, shard: int) -> Column:
    """A number in (0, 1) for a key and a shard: 52 bits of an MD5 sum."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}"))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def place(key: Column, weights: list[float]) -> Column:
    """The shard of a key among len(weights) shards; a tie goes to the lower number."""
    scores = [F.struct((-F.lit(float(w)) / F.ln(unit(key, i))).alias("score"), F.lit(-i).alias("at")) for i, w in enumerate(weights)]
    return (-F.greatest(*scores)["at"]).cast("int") if len(scores) > 1 else F.lit(0)


def places(key: Column, weights: list[float], more: float) -> tuple[Column, Column]:
    """The shard among len(weights) shards, and with one more of weight `more`."""
    best = [F.struct((-F.lit(float(w)) / F.ln(unit(key, i))).alias("score"), F.lit(-i).alias("at")) for i, w in enumerate([*weights, more])]
    now = reduce(lambda a, b: F.greatest(a, b), best[:-1]) if len(best) > 2 else best[0]
    return now, best[-1]


def assign(docs: DataFrame, shards: int = SHARDS, weights: list[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot and grown_shard (with one more shard of the mean weight)."""
    weights = list(weights or [1.0] * shards)
    now, new = places(F.col("k"), weights, sum(weights) / len(weights))
    rows = docs.select(F.col(key).alias("k"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    alike = rows.groupBy("k", "size", "text_crc32").agg(F.count("*").alias("times"))
    alike = alike.withColumns({"now": now, "new": new}).select(
        "k", "size", "text_crc32", "times",
        (-F.col("now.at")).cast("int").alias("shard"),
        (-F.greatest("now", "new")["at"]).cast("int").alias("grown_shard"),
        F.floor(unit(F.col("k"), -1) * BUCKETS).cast("int").alias("part"),
    )
    order = W.partitionBy("shard", "part").orderBy(F.col("k").asc_nulls_first(), "text_crc32", "size")
    inside = alike.withColumn("before", F.sum("times").over(order) - F.col("times"))
    parts = alike.groupBy("shard", "part").agg(F.sum("times").alias("n"))
    begins = parts.withColumn("begin", F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    rows = inside.join(F.broadcast(begins), ["shard", "part"])  # BUCKETS rows a shard
    first = F.col("begin") + F.col("before")
    blocks = rows.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / BLOCK))).alias("block"))
    each = blocks.select("*", F.explode(F.sequence(F.col("block") * BLOCK, F.least((F.col("block") + 1) * BLOCK, F.col("times")) - 1)).alias("nth"))
    return each.select(F.col("k").alias(key), "size", "text_crc32", "shard", (first + F.col("nth")).alias("slot"), "grown_shard")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    got = assign(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


#: CRC-32 goes by half a byte at a time, over a table of 16 that its polynomial gives.
_NIBBLES = [x for x in range(16)]
for _ in range(4):
    _NIBBLES = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in _NIBBLES]
_UNIT_SQL = "((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{i}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496::DOUBLE)"
_SCORES = ", ".join("-1 / ln(" + _UNIT_SQL.format(i=i) + ")" for i in range(SHARDS + 1))

OP5_SQL = f"""
WITH hexed AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h, [{_SCORES}] AS s, CAST(floor({_UNIT_SQL.format(i=-1)} * {BUCKETS}) AS INTEGER) AS part FROM documents),
halves AS (SELECT doc_id, size, s, part, list_transform(range(len(h)), lambda i: ('0x' || h[CASE i % 2 WHEN 0 THEN i + 2 ELSE i END])::BIGINT) AS x FROM hexed),
summed AS (SELECT doc_id, size, part, xor(list_reduce([4294967295::BIGINT] || x, lambda c, b: xor(c >> 4, {_NIBBLES}[(xor(c, b) & 15) + 1])), 4294967295) AS text_crc32,
                  list_position(s[1:{SHARDS}], list_max(s[1:{SHARDS}])) - 1 AS shard, list_position(s, list_max(s)) - 1 AS grown FROM halves)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM summed
"""
