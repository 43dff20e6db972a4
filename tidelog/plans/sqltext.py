"""Pieces of DuckDB SQL that several oracles share."""

from tidelog.functions.routing import md5_mod_sql

EVENTS = f"""
base AS (SELECT {md5_mod_sql("CAST(user_id AS VARCHAR)", 8)} AS partition, epoch_us(ts) // 1000 AS timestamp, CAST(user_id AS VARCHAR) AS key, props AS value,
                ts, event_id, user_id, event_type, 'txn-' || user_id AS transaction_id,
                CASE event_type WHEN 'error' THEN 'ABORT' WHEN 'signup' THEN 'COMMIT' END AS marker FROM events),
topic AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY ts, event_id) - 1 AS "offset" FROM base)"""

CHANGES = f"""
changes AS (SELECT {md5_mod_sql("CAST(o_custkey AS VARCHAR)", 8)} AS partition, CAST(o_custkey AS VARCHAR) AS key, o_orderstatus AS value, o_orderdate, o_orderkey FROM orders),
log AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY o_orderdate, o_orderkey) - 1 AS "offset" FROM changes)"""

SEGMENTS = """
segs AS (SELECT partition, CAST("offset" // 100 AS BIGINT) AS segment, min("offset") AS base_offset,
                CAST(sum(octet_length(encode(key)) + octet_length(encode(value)) + 26) AS BIGINT) AS size, max(timestamp) AS last_ts FROM topic GROUP BY 1, 2),
segments AS (SELECT *, segment = max(segment) OVER (PARTITION BY partition) AS active FROM segs)"""

#: Commits: the group is the priority, the partition the customer modulo 8; status F deletes; commits last a year.
COMMITS = """
commits AS (SELECT o_orderpriority AS group_id, CAST(o_custkey % 8 AS INTEGER) AS topic_partition, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END AS committed,
                   epoch_us(o_orderdate) // 1000 + 31536000000 AS expires, row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 8 ORDER BY o_orderdate, o_orderkey) AS seq FROM orders)"""

SEQUENCES = """
counted AS (SELECT *, sum(CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c,
                   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM topic),
sequences AS (SELECT user_id, event_id, n, CAST(CASE WHEN event_type <> 'signup' THEN c - 1 WHEN user_id % 2 = 0 THEN c + 2 ELSE c - 3 END AS BIGINT) AS seq FROM counted),
checked AS (
  SELECT user_id, event_id, n, seq, seq AS last, 'ACCEPT' AS verdict FROM sequences WHERE n = 1
  UNION ALL
  SELECT s.user_id, s.event_id, s.n, s.seq, CASE WHEN s.seq = f.last + 1 THEN s.seq ELSE f.last END,
         CASE WHEN s.seq = f.last + 1 THEN 'ACCEPT' WHEN s.seq = f.last THEN 'DUPLICATE' WHEN s.seq > f.last THEN 'GAP' ELSE 'OLD' END
  FROM checked f JOIN sequences s ON s.user_id = f.user_id AND s.n = f.n + 1)"""

REPLICAS = """
ends AS (SELECT CAST(l_suppkey % 8 AS INTEGER) AS partition, count(*) AS leo FROM lineitem GROUP BY 1),
replicas AS (SELECT partition, CAST((partition + i) % 12 AS INTEGER) AS broker, i = 0 AS is_leader,
                    CAST(leo - i * ((partition * 7) % 9) AS BIGINT) AS leo FROM ends, (SELECT unnest(range(3)) AS i)),
synced AS (SELECT r.*, max(CASE WHEN is_leader THEN leo END) OVER (PARTITION BY partition) AS leader_leo FROM replicas r),
rows_ AS (SELECT *, leader_leo - leo AS lag, is_leader OR leader_leo - leo <= 10 AS in_sync FROM synced)"""

STATES = """
steps AS (SELECT transaction_id, ts, event_id, timestamp AS since,
                 CASE event_type WHEN 'error' THEN 'PREPARE_ABORT' WHEN 'signup' THEN 'PREPARE_COMMIT' WHEN 'purchase' THEN 'COMMITTED' ELSE 'ONGOING' END AS state FROM topic),
states AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY ts, event_id) AS seq FROM steps)"""

MEMBERS = """
subs AS (SELECT DISTINCT 'm' || c_custkey AS member, c_mktsegment AS topic FROM customer),
counts AS (SELECT c_mktsegment AS topic, CAST(5 + count(*) % 13 AS INTEGER) AS partitions FROM customer GROUP BY 1),
every AS (SELECT topic, CAST(unnest(range(partitions)) AS INTEGER) AS partition FROM counts)"""
