"""Queries over logs: reads, routing, sizes, segments, the index, retention and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import routing, scalar
from tidelog.operators import fold, storage, topics
from tidelog.plans import stored
from tidelog.plans.registry import query
from tidelog.plans.sqltext import CHANGES, EVENTS, SEGMENTS

NOW = 1_706_659_200_000  # 2024-01-31, in milliseconds
#: Ids of documents that are numbered in one go.
IDS = 1 << 20
_SHOWN = ["partition", "offset", "timestamp", "key", "value"]
_SHOWN_SQL = 'partition, "offset", timestamp, key, value'


@query("topic_read", f'WITH {EVENTS} SELECT {_SHOWN_SQL} FROM topic WHERE partition = 3 AND "offset" >= 100 ORDER BY "offset" LIMIT 100')
def topic_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition from an offset on."""
    topic = stored.events(spark, sf_dir).where("partition = 3")
    return topic.where(F.col("offset") >= 100).orderBy("offset").limit(100).select(*_SHOWN)


@query("topic_read_limit_per_partition", f'WITH {EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY "offset") AS n FROM topic WHERE "offset" >= 50) SELECT {_SHOWN_SQL} FROM n WHERE n <= 20')
def topic_read_limit_per_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.read(stored.events(spark, sf_dir), 50, 20).select(*_SHOWN)


@query("point_lookup", f'WITH {EVENTS} SELECT {_SHOWN_SQL} FROM topic WHERE "offset" = 42')
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.events(spark, sf_dir).where(F.col("offset") == 42).select(*_SHOWN)


@query("list_offsets_by_time", f'WITH {EVENTS} SELECT partition, min("offset") FILTER (timestamp >= 1705312800000) AS at_time, min("offset") AS earliest, max("offset") + 1 AS latest FROM topic GROUP BY 1')
def list_offsets_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.list_offsets(stored.events(spark, sf_dir), 1_705_312_800_000)


@query("topic_stats", f'WITH {EVENTS} SELECT partition, count(*) AS records, min("offset") AS first, max("offset") AS last, count(DISTINCT "offset" // 100) AS segments FROM topic GROUP BY 1')
def topic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.stats(stored.events(spark, sf_dir))


_KEYLESS = "SELECT event_id, ts, CASE WHEN user_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END AS key FROM events"
_COUNTED = f"WITH k AS ({_KEYLESS}), c AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS n, count(*) FILTER (key IS NULL) OVER (ORDER BY ts, event_id) - 1 AS nth FROM k)"


def _keyless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which a fifth have no key, with their number among all (n) and among the keyless (nth)."""
    e = topics.table(spark, sf_dir, "events")
    rows = e.select("event_id", "ts", F.when(F.col("user_id") % 5 != 0, F.col("user_id").cast("string")).alias("key"))
    day = F.to_date("ts")
    bare = topics.globally_numbered(rows.where(F.col("key").isNull()), day, ["ts", "event_id"], "nth")
    return bare.select("event_id", "ts", "key", "nth").union(rows.where(F.col("key").isNotNull()).select("event_id", "ts", "key", F.lit(None).cast("long")))


@query("part_default", f"{_COUNTED} SELECT event_id, CASE WHEN key IS NULL THEN CAST(nth % 8 AS INTEGER) ELSE {routing.md5_mod_sql('key', 8)} END AS partition FROM c")
def part_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyless(spark, sf_dir).select("event_id", routing.default(F.col("key"), F.col("nth"), 8).alias("partition"))


@query("part_key_hash", f"SELECT event_id, {routing.md5_mod_sql('CAST(user_id AS VARCHAR)', 7)} AS partition FROM events")
def part_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.table(spark, sf_dir, "events").select("event_id", routing.key_hash(F.col("user_id").cast("string"), F.lit(0), 7).alias("partition"))


@query("part_round_robin", f"{_COUNTED} SELECT event_id, CAST(n % 8 AS INTEGER) AS partition FROM c")
def part_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = topics.table(spark, sf_dir, "events").select("event_id", "ts")
    rows = topics.globally_numbered(e, F.to_date("ts"), ["ts", "event_id"], "n")
    return rows.select("event_id", routing.round_robin(F.lit(None), F.col("n"), 8).alias("partition"))


@query("part_sticky", f"{_COUNTED} SELECT event_id, CASE WHEN key IS NULL THEN CAST(((nth + 1) // 100) % 8 AS INTEGER) ELSE {routing.md5_mod_sql('key', 8)} END AS partition FROM c")
def part_sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyless(spark, sf_dir).select("event_id", routing.sticky(F.col("key"), F.col("nth"), 8).alias("partition"))


@query("part_random", f"SELECT event_id, {routing.md5_mod_sql("CAST(event_id AS VARCHAR) || ':0'", 8)} AS partition FROM events")
def part_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, by number and seed."""
    return topics.table(spark, sf_dir, "events").select("event_id", routing.partitioner("random")(F.lit(None), F.col("event_id"), 8).alias("partition"))


@query("frame_size", "SELECT event_id, CAST(octet_length(encode(CAST(user_id AS VARCHAR))) + octet_length(encode(props)) + 26 AS BIGINT) AS size FROM events")
def frame_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.table(spark, sf_dir, "events").select("event_id", scalar.frame_size(F.col("user_id").cast("string"), F.col("props")).alias("size"))


_BYTES = "CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT)"


@query("compress_estimate", f"SELECT doc_id, {_BYTES} AS none, CAST(floor({_BYTES} * 0.3::DOUBLE) AS BIGINT) AS gzip, CAST(floor({_BYTES} * 0.5::DOUBLE) AS BIGINT) AS snappy, CAST(floor({_BYTES} * 0.6::DOUBLE) AS BIGINT) AS lz4 FROM documents")
def compress_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = scalar.octets(F.col("text"))
    return topics.table(spark, sf_dir, "documents").select("doc_id", *(scalar.compressed_estimate(size, c).alias(c) for c in scalar.CODEC_PARTS))


@query("should_compress", f"SELECT doc_id, {_BYTES} >= 1024 AS compress FROM documents")
def should_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.table(spark, sf_dir, "documents").select("doc_id", scalar.worth_compressing(scalar.octets(F.col("text"))).alias("compress"))


_CHUNKS = """
{name} AS (
  SELECT {key}, n, {shown}, CAST(0 AS BIGINT) AS chunk, size AS filled FROM {rows} WHERE n = 1
  UNION ALL
  SELECT s.{key}, s.n, {shown_s}, CASE WHEN f.filled >= {limit} THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.filled >= {limit} THEN s.size ELSE f.filled + s.size END
  FROM {name} f JOIN {rows} s ON s.{key} = f.{key} AND s.n = f.n + 1)"""
_DOC_ROWS = "docs AS (SELECT source, doc_id, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)"


@query("segments_greedy", f"WITH RECURSIVE {_DOC_ROWS}, {_CHUNKS.format(name='f', key='source', shown='doc_id', shown_s='s.doc_id', rows='docs', limit=16384)} SELECT source, doc_id, chunk AS segment FROM f")
def segments_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment closes with the record that fills it."""
    docs = topics.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return fold.ordered_fold(docs, ["source"], ["doc_id"], ["n_chars"], *fold.greedy_chunks(16384), "segment long").select("source", "doc_id", "segment")


_SIZED = f'WITH RECURSIVE {EVENTS}, sized AS (SELECT partition, "offset", timestamp, CAST(octet_length(encode(key)) + octet_length(encode(value)) AS BIGINT) AS size, "offset" + 1 AS n FROM topic)'


@query("batches_by_size", f"""{_SIZED}, {_CHUNKS.format(name='f', key='partition', shown='size', shown_s='s.size', rows='sized', limit=1024)}
SELECT partition, chunk AS batch, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1, 2""")
def batches_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last batch of a partition is what a flush finds."""
    rows = stored.events(spark, sf_dir).select("partition", "offset", (F.octet_length("key") + F.octet_length("value")).cast("long").alias("size"))
    found = fold.ordered_fold(rows, ["partition"], ["offset"], ["size"], *fold.greedy_chunks(1024), "batch long")
    return found.groupBy("partition", "batch").agg(F.count("*").alias("records"), F.sum("size").alias("bytes"))


@query("batches_drained", f"""{_SIZED}, {_CHUNKS.format(name='f', key='partition', shown='size', shown_s='s.size', rows='sized', limit=1024)}
SELECT partition, count(DISTINCT chunk) FILTER (chunk < 5) AS in_flight, count(DISTINCT chunk) FILTER (chunk >= 5) AS pending, count(*) FILTER (chunk < 5) AS sent FROM f GROUP BY 1""")
def batches_drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a drain sends of each partition's batches with five in flight at most, and what has to wait."""
    first = F.col("batch") < 5
    rows = batches_by_size(spark, sf_dir)
    return rows.groupBy("partition").agg(F.count_if(first).alias("in_flight"), F.count_if(~first).alias("pending"), F.sum(F.when(first, F.col("records"))).alias("sent"))


@query("segments_by_age", f"""{_SIZED}, f AS (
  SELECT partition, "offset", n, timestamp, size AS filled, CAST(0 AS BIGINT) AS segment, timestamp AS made FROM sized WHERE n = 1
  UNION ALL
  SELECT s.partition, s."offset", s.n, s.timestamp, CASE WHEN f.filled >= 16384 OR s.timestamp - f.made >= 604800000 THEN s.size ELSE f.filled + s.size END,
         CASE WHEN f.filled >= 16384 OR s.timestamp - f.made >= 604800000 THEN f.segment + 1 ELSE f.segment END, CASE WHEN f.filled >= 16384 OR s.timestamp - f.made >= 604800000 THEN s.timestamp ELSE f.made END
  FROM f JOIN sized s ON s.partition = f.partition AND s.n = f.n + 1)
SELECT partition, segment, min("offset") AS base_offset, count(*) AS records FROM f GROUP BY 1, 2""")
def segments_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment closes before the record that finds it full (16 KiB) or a week old."""
    rows = stored.events(spark, sf_dir).select("partition", "offset", "timestamp", (F.octet_length("key") + F.octet_length("value")).cast("long").alias("size"))
    found = fold.ordered_fold(rows, ["partition"], ["offset"], ["size", "timestamp"], *fold.rotation(16384, 604_800_000), "segment long")
    return found.groupBy("partition", "segment").agg(F.min("offset").alias("base_offset"), F.count("*").alias("records"))


@query("batches_by_age", f"""{_SIZED}, f AS (
  SELECT partition, n, timestamp, CAST(0 AS BIGINT) AS batch, timestamp AS created FROM sized WHERE n = 1
  UNION ALL
  SELECT s.partition, s.n, s.timestamp, CASE WHEN s.timestamp - f.created >= 3600000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN s.timestamp - f.created >= 3600000 THEN s.timestamp ELSE f.created END
  FROM f JOIN sized s ON s.partition = f.partition AND s.n = f.n + 1)
SELECT partition, batch, count(*) AS records, min(timestamp) AS created FROM f GROUP BY 1, 2""")
def batches_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 with a linger of an hour."""
    rows = stored.events(spark, sf_dir).select("partition", "offset", "timestamp")
    found = fold.ordered_fold(rows, ["partition"], ["offset"], ["timestamp"], *fold.age_chunks(3_600_000), "batch long")
    return found.groupBy("partition", "batch").agg(F.count("*").alias("records"), F.min("timestamp").alias("created"))


_FRAMES = "framed AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, CAST(coalesce(octet_length(encode(text)), 0) + 26 AS BIGINT) AS size FROM documents)"
_INDEX = f"""{_FRAMES}, f AS (
  SELECT source, n, size, CAST(0 AS BIGINT) AS position, CAST(0 AS BIGINT) AS indexed, FALSE AS entry FROM framed WHERE n = 1
  UNION ALL
  SELECT s.source, s.n, s.size, f.position + f.size, CASE WHEN f.position + f.size - f.indexed >= 4096 THEN f.position + f.size ELSE f.indexed END, f.position + f.size - f.indexed >= 4096
  FROM f JOIN framed s ON s.source = f.source AND s.n = f.n + 1),
entries AS (SELECT source, n - 1 AS "offset", position FROM f WHERE entry)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = topics.table(spark, sf_dir, "documents").select("source", "doc_id", scalar.frame_size(F.lit(None).cast("string"), F.col("text")).alias("size"))
    rows = topics.numbered(docs, ["doc_id"], by=("source",), stretch=F.floor(F.col("doc_id") / IDS))
    found = fold.ordered_fold(rows, ["source"], ["offset"], ["size"], *fold.sparse_index(4096), "position long, entry boolean")
    return found.where("entry").select("source", "offset", "position")


@query("index_build", f'WITH RECURSIVE {_INDEX} SELECT source, "offset" AS rel_offset, position FROM entries')
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry for each record that lies 4096 bytes or more behind the last entry."""
    return _index(spark, sf_dir).withColumnRenamed("offset", "rel_offset")


@query("index_floor_lookup", f"""WITH RECURSIVE {_INDEX}, probes AS (SELECT source, n - 1 AS "offset" FROM framed)
SELECT p.source, p."offset", e."offset" AS rel_offset, e.position FROM probes p ASOF LEFT JOIN entries e ON p.source = e.source AND p."offset" >= e."offset" """)
def index_floor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index entry from which a lookup would scan."""
    docs = topics.table(spark, sf_dir, "documents").select("source", "doc_id")
    probes = topics.numbered(docs, ["doc_id"], by=("source",), stretch=F.floor(F.col("doc_id") / IDS))
    return storage.floor_lookup(_index(spark, sf_dir), probes, "source")


@query("index_validate", f"""WITH RECURSIVE {_INDEX}, stored AS (SELECT source, "offset", CASE WHEN "offset" % 11 = 0 THEN position + 1 ELSE position END AS position FROM entries)
(SELECT *, 'stored' AS side FROM (SELECT * FROM stored EXCEPT ALL SELECT * FROM entries)) UNION ALL (SELECT *, 'rebuilt' FROM (SELECT * FROM entries EXCEPT ALL SELECT * FROM stored))""")
def index_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A damaged index against its rebuild."""
    rebuilt = _index(spark, sf_dir)
    stored = rebuilt.withColumn("position", F.when(F.col("offset") % 11 == 0, F.col("position") + 1).otherwise(F.col("position")))
    return storage.index_differences(stored, rebuilt)


@query("index_truncate", f'WITH RECURSIVE {_INDEX}, ends AS (SELECT source, count(*) // 2 AS "end" FROM documents GROUP BY 1) SELECT source, e."offset" AS rel_offset, position FROM entries e JOIN ends USING (source) WHERE e."offset" < "end"')
def index_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that stay when each log is cut to its first half."""
    ends = topics.table(spark, sf_dir, "documents").groupBy("source").agg(F.floor(F.count("*") / 2).alias("end"))
    return storage.index_truncated(_index(spark, sf_dir), ends, "source").withColumnRenamed("offset", "rel_offset")


@query("index_recover", f"""WITH RECURSIVE {_INDEX}, ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY "offset") AS nth FROM entries),
stored AS (SELECT *, CASE WHEN "offset" % 11 = 0 THEN position + 1 ELSE position END AS damaged FROM ranked),
bad AS (SELECT DISTINCT source FROM stored WHERE nth <= 10 AND damaged <> position)
SELECT source, "offset" AS rel_offset, CASE WHEN source IN (FROM bad) THEN position ELSE damaged END AS position, source NOT IN (FROM bad) AS kept FROM stored""")
def index_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index is kept if its first ten entries are those of a rebuild; else the rebuild takes its place."""
    rebuilt = _index(spark, sf_dir)
    found = rebuilt.withColumn("position", F.when(F.col("offset") % 11 == 0, F.col("position") + 1).otherwise(F.col("position")))
    return storage.index_recovered(found, rebuilt, "source").withColumnRenamed("offset", "rel_offset")


_CLOSED = f"WITH {EVENTS}, {SEGMENTS}"
_AGE = f"(NOT active AND {NOW} - last_ts > 1209600000)"
_OVER = "(NOT active AND coalesce(sum(CASE WHEN active THEN 0 ELSE size END) OVER (PARTITION BY partition ORDER BY base_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < sum(size) OVER (PARTITION BY partition) - 20000)"
_SEGMENT_COLUMNS = "partition, segment, base_offset, size, last_ts, active"


@query("retention_time", f'{_CLOSED} SELECT {_SEGMENT_COLUMNS}, {_AGE} AS "delete" FROM segments')
def retention_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.retention(storage.segments(stored.events(spark, sf_dir)), NOW, hours=336)


@query("retention_size", f'{_CLOSED} SELECT {_SEGMENT_COLUMNS}, {_OVER} AS "delete" FROM segments')
def retention_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.retention(storage.segments(stored.events(spark, sf_dir)), NOW, limit=20_000)


@query("retention_both", f'{_CLOSED} SELECT {_SEGMENT_COLUMNS}, {_AGE} OR {_OVER} AS "delete" FROM segments')
def retention_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.retention(storage.segments(stored.events(spark, sf_dir)), NOW, hours=336, limit=20_000)


@query("segment_names", f"{_CLOSED} SELECT partition, base_offset, lpad(CAST(base_offset AS VARCHAR), 20, '0') || '.log' AS log_name, lpad(CAST(base_offset AS VARCHAR), 20, '0') || '.index' AS index_name FROM segments")
def segment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18, S14."""
    found = storage.segments(stored.events(spark, sf_dir))
    return found.select("partition", "base_offset", scalar.file_name(F.col("base_offset")).alias("log_name"), scalar.file_name(F.col("base_offset"), ".index").alias("index_name"))


@query("segment_prune", f"""{_CLOSED}, n AS (SELECT *, lead(base_offset) OVER (PARTITION BY partition ORDER BY base_offset) AS next_offset FROM segments)
SELECT partition, segment, base_offset, next_offset FROM n WHERE next_offset IS NULL OR next_offset > 250""")
def segment_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments that a read from offset 250 on opens."""
    return storage.pruned(storage.segments(stored.events(spark, sf_dir)), 250).select("partition", "segment", "base_offset", "next_offset")


_LATEST = f'WITH {CHANGES}, latest AS (SELECT partition, key, min("offset") AS first, max("offset") AS last, arg_max(value, "offset") AS value FROM log GROUP BY 1, 2)'


@query("compact_latest_per_key", f'{_LATEST} SELECT partition, key, row_number() OVER (PARTITION BY partition ORDER BY first) - 1 AS "offset", value FROM latest')
def compact_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.compact(stored.changes(spark, sf_dir))


@query("compact_preserve_offsets", f'{_LATEST} SELECT partition, key, last AS "offset", value FROM latest')
def compact_preserve_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.compact(stored.changes(spark, sf_dir), preserve_offsets=True)


@query("compaction_gate", f"WITH {CHANGES} SELECT partition, count(*) AS records, count(DISTINCT key) AS keys, round(1 - count(DISTINCT key) / count(*), 6) AS ratio, 1 - count(DISTINCT key) / count(*) >= 0.5 AS compacts FROM log GROUP BY 1")
def compaction_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.compaction_gate(stored.changes(spark, sf_dir))


@query("fetch_batch", f"""WITH {EVENTS}, req AS (SELECT CAST(unnest(range(8)) AS INTEGER) AS partition), r AS (SELECT partition, CAST(partition * 10 AS BIGINT) AS start, CAST(500 + 100 * partition AS BIGINT) AS max_bytes FROM req),
x AS (SELECT t.partition, t."offset", r.max_bytes, sum(octet_length(encode(key)) + octet_length(encode(value)) + 26) OVER (PARTITION BY t.partition ORDER BY t."offset") AS upto FROM topic t JOIN r ON t.partition = r.partition AND t."offset" >= r.start)
SELECT partition, count(*) AS records, min("offset") AS first, max("offset") AS last, CAST(max(upto) AS BIGINT) AS bytes FROM x WHERE upto <= max_bytes GROUP BY 1""")
def fetch_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each requested partition the records from an offset on that fit its bytes."""
    found = topics.fetch(stored.events(spark, sf_dir), {p: (10 * p, 500 + 100 * p) for p in range(8)})
    return found.groupBy("partition").agg(F.count("*").alias("records"), F.min("offset").alias("first"), F.max("offset").alias("last"), F.max("upto").alias("bytes"))


@query("adaptive_fetch", """WITH RECURSIVE g AS (SELECT user_id, CAST(round(value * 9000) AS BIGINT) AS got, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS got, CAST(65536 AS BIGINT) AS size, 0 AS fulls, 0 AS empties FROM (SELECT DISTINCT user_id FROM g)
  UNION ALL
  SELECT user_id, n, got, CASE WHEN fulls >= 3 THEN least(2 * size, 1048576) WHEN empties >= 5 THEN greatest(size // 2, 4096) ELSE size END, CASE WHEN fulls >= 3 THEN 0 ELSE fulls END, CASE WHEN fulls < 3 AND empties >= 5 THEN 0 ELSE empties END FROM (
    SELECT g.user_id, g.n, g.got, f.size, CASE WHEN g.got / f.size >= 0.9 THEN f.fulls + 1 ELSE 0 END AS fulls, CASE WHEN g.got / f.size < 0.3 THEN f.empties + 1 ELSE 0 END AS empties FROM f JOIN g ON g.user_id = f.user_id AND g.n = f.n + 1))
SELECT user_id, n, got, size FROM f WHERE n > 0""")
def adaptive_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next fetch size after each fetch; the bytes got are made from the events' values."""
    e = topics.table(spark, sf_dir, "events")
    rows = topics.numbered(e, ["ts", "event_id"], "n", ("user_id",)).select("user_id", (F.col("n") + 1).alias("n"), F.round(F.col("value") * 9000).cast("long").alias("got"))
    return fold.ordered_fold(rows, ["user_id"], ["n"], ["got"], *fold.adaptive_size(), "size long")


@query("transfer_method", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'standard' WHEN n_chars * 16 > 65536 THEN 'sendfile' WHEN n_chars * 16 BETWEEN 4096 AND 104857600 THEN 'mmap' ELSE 'standard' END AS method, CASE WHEN n_chars <= 4096 THEN 'small' WHEN n_chars <= 65536 THEN 'medium' ELSE 'large' END AS pool FROM documents")
def transfer_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S21 and the size classes of S23."""
    return topics.table(spark, sf_dir, "documents").select("doc_id", scalar.transfer_method(F.col("n_chars") * 16, F.col("doc_id") % 10 == 0).alias("method"), scalar.size_class(F.col("n_chars")).alias("pool"))


@query("backoff", "SELECT event_id, CAST(least(100 * pow(2, event_id % 12), 32000) AS BIGINT) AS wait_ms FROM events")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.table(spark, sf_dir, "events").select("event_id", scalar.backoff_ms(F.lit(100), F.col("event_id") % 12).alias("wait_ms"))


@query("backoff_jitter", f"SELECT event_id, CAST(least(100 * pow(2, event_id % 12), 32000) AS BIGINT) + {routing.md5_mod_sql("CAST(event_id AS VARCHAR) || ':0'", 21)} AS wait_ms FROM events")
def backoff_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12 with up to 20 ms more."""
    e = F.col("event_id")
    return topics.table(spark, sf_dir, "events").select("event_id", scalar.jittered_ms(F.lit(100), e % 12, e).alias("wait_ms"))


_MESSAGE = "CASE event_id % 6 WHEN 0 THEN 'Request TIMEOUT after ' || event_id WHEN 1 THEN 'Connection refused' WHEN 2 THEN 'unknown topic' WHEN 3 THEN 'Broken pipe!' WHEN 4 THEN 'the service unavailable now' END"


@query("retryable_errors", f"SELECT event_id, CASE event_id % 7 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE coalesce(regexp_matches(lower({_MESSAGE}), 'timeout|connection refused|connection reset|broken pipe|temporarily unavailable|service unavailable'), FALSE) END AS retry FROM events")
def retryable_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 6
    message = F.when(kind == 0, F.concat(F.lit("Request TIMEOUT after "), F.col("event_id").cast("string"))).when(kind == 1, "Connection refused").when(kind == 2, "unknown topic").when(kind == 3, "Broken pipe!").when(kind == 4, "the service unavailable now")
    type_ = F.when(F.col("event_id") % 7 == 0, "RetryableError").when(F.col("event_id") % 7 == 1, "NonRetryableError")
    return topics.table(spark, sf_dir, "events").select("event_id", scalar.retryable(message, type_).alias("retry"))


@query("parse_servers", "WITH s AS (SELECT s_suppkey, unnest(['host' || s_suppkey || ':' || (9092 + s_suppkey % 3), 'alt-' || s_nationkey]) AS server, unnest([0, 1]) AS id FROM supplier) SELECT s_suppkey, id, split_part(server, ':', 1) AS host, CAST(split_part(server, ':', 2) AS INTEGER) AS port FROM s WHERE len(string_split(server, ':')) = 2")
def parse_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host:port parts; what has no port is dropped."""
    s = topics.table(spark, sf_dir, "supplier")
    text = F.concat(F.lit("host"), F.col("s_suppkey").cast("string"), F.lit(":"), (9092 + F.col("s_suppkey") % 3).cast("string"), F.lit(",alt-"), F.col("s_nationkey").cast("string"))
    each = s.select("s_suppkey", F.posexplode(F.split(text, ",")).alias("id", "server")).withColumn("parts", F.split("server", ":")).where(F.size("parts") == 2)
    return each.select("s_suppkey", "id", F.col("parts")[0].alias("host"), F.col("parts")[1].cast("int").alias("port"))


@query("compression_benchmark", f"SELECT codec, count(*) AS documents, CAST(sum({_BYTES}) AS BIGINT) AS bytes, count(*) AS restored, codec <> 'none' AS smaller FROM documents, (SELECT unnest(['none', 'gzip', 'snappy', 'lz4', 'zstd']) AS codec) GROUP BY 1")
def compression_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each codec how many documents came back as they were, and whether it made all of them together smaller."""
    from tidelog.functions.codecs import CODECS

    sizes = compression_sizes(spark, sf_dir)
    each = sizes.select("none", "same", F.explode(F.array(*(F.struct(F.lit(c).alias("codec"), F.col(c).alias("size")) for c in CODECS))).alias("x"))
    sums = each.groupBy("x.codec").agg(F.count("*").alias("documents"), F.sum("none").alias("bytes"), F.count_if("same").alias("restored"), F.sum("x.size").alias("size"))
    return sums.select("codec", "documents", "bytes", "restored", (F.col("size") < F.col("bytes")).alias("smaller"))


@query("compression_sizes")
def compression_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each document's bytes under each codec; no SQL compresses."""
    from tidelog.functions.codecs import benchmark

    return benchmark(topics.table(spark, sf_dir, "documents"), "doc_id", "text")


@query("frame_round_trip", f"WITH {EVENTS} SELECT {_SHOWN_SQL}, CAST(NULL AS VARCHAR) AS error FROM topic")
def frame_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to frames with CRC-32C and back."""
    from tidelog.functions.frames import decoded, encoded

    topic = stored.events(spark, sf_dir).select("partition", "offset", "timestamp", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    return decoded(encoded(topic)).select("partition", "offset", "timestamp", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"), "error")
