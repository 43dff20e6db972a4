"""Queries over state: isolation, sequences, offsets, groups and transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions import scalar
from tidelog.operators import fold, groups, offsets, storage, topics, txn
from tidelog.plans import stored
from tidelog.plans.registry import query
from tidelog.plans.sqltext import COMMITS, EVENTS, MEMBERS, SEQUENCES, STATES

_SHOWN = ["partition", "offset", "key", "value"]
_SHOWN_SQL = 'partition, "offset", key, value'
_HIDDEN = "EXISTS (SELECT 1 FROM {topic} a WHERE a.marker = 'ABORT' AND a.transaction_id = {t}.transaction_id AND (a.partition, a.\"offset\") < ({t}.partition, {t}.\"offset\"))"
#: Transactions of eight events in a row, over several partitions; a fifth of the records has none.
_SHARED = "shared AS (SELECT * REPLACE (CASE WHEN event_id % 5 <> 0 THEN 'txn-' || (event_id // 8) END AS transaction_id) FROM topic)"


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return stored.events(spark, sf_dir).withColumn("transaction_id", F.when(e % 5 != 0, F.concat(F.lit("txn-"), F.floor(e / 8).cast("string"))))


@query("read_uncommitted", f"WITH {EVENTS} SELECT {_SHOWN_SQL}, marker FROM topic")
def read_uncommitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.events(spark, sf_dir).select(*_SHOWN, "marker")


@query("read_committed", f"WITH {EVENTS}, {_SHARED} SELECT {_SHOWN_SQL} FROM shared t WHERE marker IS NULL AND NOT {_HIDDEN.format(topic='shared', t='t')}")
def read_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 over transactions of several partitions, which are drained in order."""
    return txn.read_committed(_shared(spark, sf_dir)).select(*_SHOWN)


@query("read_committed_lso", f"""WITH {EVENTS}, {_SHARED}, e AS (SELECT partition, transaction_id, max("offset") AS "end" FROM shared WHERE marker IS NOT NULL AND transaction_id IS NOT NULL GROUP BY 1, 2)
SELECT t.partition, t."offset", t.key, t.value FROM shared t LEFT JOIN e ON t.partition = e.partition AND t.transaction_id = e.transaction_id
WHERE t.marker IS NULL AND (t.transaction_id IS NULL OR (t."offset" < "end" AND t.transaction_id NOT IN (SELECT transaction_id FROM shared WHERE marker = 'ABORT' AND transaction_id IS NOT NULL)))""")
def read_committed_lso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing of a transaction that was aborted anywhere, or that is open in the record's partition."""
    return txn.read_committed_lso(_shared(spark, sf_dir)).select(*_SHOWN)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = stored.events(spark, sf_dir)
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    c = F.sum(F.when(F.col("marker").isNotNull(), 0).otherwise(1)).over(order)
    n = F.row_number().over(order).cast("long")
    seq = F.when(F.col("event_type") != "signup", F.col("c") - 1).when(F.col("user_id") % 2 == 0, F.col("c") + 2).otherwise(F.col("c") - 3)
    return topic.withColumns({"c": c, "n": n}).select("user_id", "event_id", "n", seq.cast("long").alias("seq"), "partition", "offset", "timestamp", "key", "value", "marker", "transaction_id")


@query("seq_assign", f'WITH {EVENTS} SELECT event_id, row_number() OVER (PARTITION BY user_id, partition ORDER BY "offset") - 1 AS seq FROM topic')
def seq_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence numbers from 0 for each producer and partition."""
    return topics.numbered(stored.events(spark, sf_dir), ["offset"], "seq", ("user_id", "partition"), F.floor(F.col("offset") / storage.STRETCH)).select("event_id", "seq")


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.ordered_fold(sequences(spark, sf_dir), ["user_id"], ["n"], ["seq"], *fold.sequence_check(), "verdict string")


@query("seq_validate", f"WITH RECURSIVE {EVENTS}, {SEQUENCES} SELECT event_id, seq, verdict FROM checked")
def seq_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("event_id", "seq", "verdict")


@query("seq_dedup_accepted", f"WITH RECURSIVE {EVENTS}, {SEQUENCES} SELECT user_id, event_id, seq FROM checked WHERE verdict = 'ACCEPT' AND user_id % 10 <> 9")
def seq_dedup_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known producers only, and of these what is accepted."""
    known = topics.table(spark, sf_dir, "events").where("user_id % 10 <> 9").select("user_id").distinct()
    return checked(spark, sf_dir).join(known, "user_id", "left_semi").where("verdict = 'ACCEPT'").select("user_id", "event_id", "seq")


@query("seq_turns", "SELECT conv_id, turn, CASE WHEN b IS NULL OR turn = b + 1 THEN 'ACCEPT' WHEN turn = b THEN 'DUPLICATE' WHEN turn > b THEN 'GAP' ELSE 'OLD' END AS verdict FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)")
def seq_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4 on clean sequences: the turns of conversations."""
    turns = topics.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return fold.ordered_fold(turns, ["conv_id"], ["turn"], ["turn"], *fold.sequence_check(), "verdict string")


@query("pid_assignment", f"WITH {EVENTS}, f AS (SELECT user_id, min((timestamp, event_id)) AS first FROM topic GROUP BY 1) SELECT user_id, row_number() OVER (ORDER BY first) - 1 AS producer_id FROM f")
def pid_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Producer ids in the order of first appearance."""
    topic = stored.events(spark, sf_dir)
    first = topic.groupBy("user_id").agg(F.min(F.struct("timestamp", "event_id")).alias("first"))
    day = F.floor(F.col("first.timestamp") / 86_400_000)
    return topics.globally_numbered(first, day, ["first"], "producer_id").select("user_id", "producer_id")


YEAR = 31_536_000_000
COMMITS_NOW = 978_307_200_000  # 2001-01-01


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = topics.table(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_orderpriority").alias("group_id"), (F.col("o_custkey") % 8).cast("int").alias("topic_partition"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey")).alias("committed"), (topics.millis("o_orderdate", o) + YEAR).alias("expires"), "o_orderdate", "o_orderkey",
    )
    return topics.numbered(rows, ["o_orderdate", "o_orderkey"], "seq", ("group_id", "topic_partition"), F.date_trunc("month", "o_orderdate"))


_LAST = f"WITH {COMMITS}, last AS (SELECT group_id, topic_partition, arg_max(struct_pack(c := committed, e := expires), seq) AS l FROM commits {{where}} GROUP BY 1, 2)"
_CURRENT = f"{_LAST.format(where='')}, current AS (SELECT group_id, topic_partition, l.c AS committed FROM last WHERE l.c IS NOT NULL AND l.e >= {COMMITS_NOW})"


@query("offsets_current", f"{_CURRENT} SELECT * FROM current")
def offsets_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last commit; an empty one deletes."""
    return offsets.current(commits(spark, sf_dir), COMMITS_NOW)


@query("offsets_fetch_all", f"{_LAST.format(where=f'WHERE expires >= {COMMITS_NOW} OR committed IS NULL')} SELECT group_id, topic_partition, l.c AS committed FROM last WHERE l.c IS NOT NULL")
def offsets_fetch_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offsets.fetch_all(commits(spark, sf_dir), COMMITS_NOW)


@query("active_groups", f"WITH {COMMITS} SELECT DISTINCT group_id FROM commits WHERE expires >= {COMMITS_NOW} AND committed IS NOT NULL")
def active_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offsets.active_groups(commits(spark, sf_dir), COMMITS_NOW)


@query("offset_keys", f"WITH {COMMITS} SELECT DISTINCT group_id || ':orders:' || topic_partition AS key, group_id AS \"group\", 'orders' AS topic, topic_partition AS partition FROM commits")
def offset_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15, there and back."""
    rows = commits(spark, sf_dir).select("group_id", "topic_partition").distinct()
    keyed = rows.select(scalar.offset_key(F.col("group_id"), F.lit("orders"), F.col("topic_partition")).alias("key"))
    return keyed.withColumn("x", scalar.split_offset_key(F.col("key"))).select("key", "x.*")


@query("offset_json", f"WITH {COMMITS} SELECT group_id, topic_partition, seq - 1 AS seq, committed, expires FROM commits WHERE committed IS NOT NULL")
def offset_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: commits as JSON values and back."""
    rows = commits(spark, sf_dir).where("committed IS NOT NULL")
    text = rows.select("group_id", "topic_partition", "seq", F.to_json(F.struct("committed", "expires")).alias("json"))
    return text.withColumn("x", F.from_json("json", "committed long, expires long")).select("group_id", "topic_partition", "seq", "x.committed", "x.expires")


_ENDS = f"{EVENTS}, ends AS (SELECT partition AS topic_partition, max(\"offset\") + 1 AS log_end FROM topic GROUP BY 1)"


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.events(spark, sf_dir).groupBy(F.col("partition").alias("topic_partition")).agg((F.max("offset") + 1).alias("log_end"))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten partitions for each group."""
    return topics.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("group_id")).distinct().withColumn("topic_partition", F.explode(F.sequence(F.lit(0), F.lit(9))))


_ASSIGNED = "asked AS (SELECT DISTINCT o_orderpriority AS group_id FROM orders), assigned AS (SELECT group_id, CAST(unnest(range(10)) AS INTEGER) AS topic_partition FROM asked)"


@query("reset_start_offsets", f"""{_CURRENT}, {_ENDS}, {_ASSIGNED}
SELECT a.group_id, a.topic_partition, CAST(coalesce(committed, log_end, -1) AS BIGINT) AS start, CASE WHEN committed IS NOT NULL THEN 'committed' ELSE 'latest' END AS how
FROM assigned a LEFT JOIN current c ON a.group_id = c.group_id AND a.topic_partition = c.topic_partition LEFT JOIN ends e ON a.topic_partition = e.topic_partition""")
def reset_start_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits, else the log end, for partitions of which two have neither."""
    committed = offsets.current(commits(spark, sf_dir), COMMITS_NOW)
    return offsets.start_offsets(assigned(spark, sf_dir), committed, ends(spark, sf_dir), "latest")


_LAG = f"""{_CURRENT}, {_ENDS}, g AS (SELECT DISTINCT group_id FROM current),
lags AS (SELECT g.group_id, e.topic_partition, e.log_end, c.committed, e.log_end - c.committed AS lag FROM g, ends e LEFT JOIN current c ON c.group_id = g.group_id AND c.topic_partition = e.topic_partition)"""


@query("consumer_lag", f"{_LAG} SELECT * FROM lags")
def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offsets.lag(offsets.current(commits(spark, sf_dir), COMMITS_NOW), ends(spark, sf_dir), topics.PARTITIONS)


@query("group_total_lag", f"{_LAG} SELECT group_id, CAST(sum(lag) AS BIGINT) AS lag, count(lag) AS partitions FROM lags GROUP BY 1")
def group_total_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumer_lag(spark, sf_dir).groupBy("group_id").agg(F.sum("lag").alias("lag"), F.count("lag").alias("partitions"))


@query("commit_advanced", f"""{_CURRENT}, p AS (SELECT o_orderpriority AS group_id, CAST(o_custkey % 8 AS INTEGER) AS topic_partition, max(o_orderkey) + 1 AS position FROM orders GROUP BY 1, 2)
SELECT p.* FROM p LEFT JOIN current c ON p.group_id = c.group_id AND p.topic_partition = c.topic_partition WHERE position > coalesce(committed, -1)""")
def commit_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions beyond what is committed."""
    o = topics.table(spark, sf_dir, "orders")
    positions = o.groupBy(F.col("o_orderpriority").alias("group_id"), (F.col("o_custkey") % 8).cast("int").alias("topic_partition")).agg((F.max("o_orderkey") + 1).alias("position"))
    return offsets.advanced(positions, offsets.current(commits(spark, sf_dir), COMMITS_NOW))


def group(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = topics.table(spark, sf_dir, "customer")
    subs = c.select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("member"), F.col("c_mktsegment").alias("topic")).distinct()
    counts = c.groupBy(F.col("c_mktsegment").alias("topic")).agg((5 + F.count("*") % 13).cast("int").alias("partitions"))
    return subs, counts


@query("assign_range", f"""WITH {MEMBERS}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY member) - 1 AS r, count(*) OVER (PARTITION BY topic) AS m FROM subs JOIN counts USING (topic)),
s AS (SELECT topic, member, r * (partitions // m) + least(r, partitions % m) AS start, partitions // m + CASE WHEN r < partitions % m THEN 1 ELSE 0 END AS n FROM r)
SELECT topic, member, CAST(unnest(range(start, start + n)) AS INTEGER) AS partition FROM s""")
def assign_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.strategy("range")(*group(spark, sf_dir))


_TURNS = f"""WITH {{recursive}} {MEMBERS}, members AS (SELECT member, row_number() OVER (ORDER BY member) - 1 AS r, count(*) OVER () AS m FROM (SELECT DISTINCT member FROM subs))"""


@query("assign_round_robin", f"""{_TURNS.format(recursive='')}, t AS (SELECT *, row_number() OVER (ORDER BY topic, partition) - 1 AS n FROM every)
SELECT t.topic, t.partition, CASE WHEN s.member IS NOT NULL THEN s.member END AS member FROM t JOIN members m ON m.r = t.n % m.m LEFT JOIN subs s ON s.member = m.member AND s.topic = t.topic""")
def assign_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unassigned partitions have no member."""
    return groups.round_robin_assignment(*group(spark, sf_dir))


_PREVIOUS = "SELECT 'm' || c_custkey AS member, c_mktsegment AS topic, CAST(c_custkey % 4 AS INTEGER) AS partition FROM customer"


@query("assign_sticky", f"""{_TURNS.format(recursive='RECURSIVE')}, previous AS ({_PREVIOUS}),
valid AS (SELECT p.topic, p.partition, min(p.member) AS member FROM previous p JOIN subs s ON p.topic = s.topic AND p.member = s.member JOIN every e ON e.topic = p.topic AND e.partition = p.partition GROUP BY 1, 2),
rest AS (SELECT e.topic, e.partition, row_number() OVER (ORDER BY e.topic, e.partition) AS n FROM every e ANTI JOIN valid v ON e.topic = v.topic AND e.partition = v.partition),
f AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS topic, CAST(NULL AS INTEGER) AS partition, CAST(NULL AS VARCHAR) AS member, CAST(0 AS BIGINT) AS cursor
  UNION ALL
  SELECT x.n, x.topic, x.partition, x.member, CASE WHEN x.r IS NULL THEN x.cursor ELSE (x.r + 1) % x.m END FROM (
    SELECT r.n, r.topic, r.partition, f.cursor, any_value(m.m) AS m, arg_min(m.member, (m.r - f.cursor + m.m) % m.m) AS member, arg_min(m.r, (m.r - f.cursor + m.m) % m.m) AS r
    FROM f JOIN rest r ON r.n = f.n + 1 LEFT JOIN subs s ON s.topic = r.topic LEFT JOIN members m ON m.member = s.member GROUP BY 1, 2, 3, 4) x)
SELECT topic, partition, member, TRUE AS kept FROM valid UNION ALL SELECT topic, partition, member, FALSE FROM f WHERE n > 0""")
def assign_sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = topics.table(spark, sf_dir, "customer")
    previous = c.select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("member"), F.col("c_mktsegment").alias("topic"), (F.col("c_custkey") % 4).cast("int").alias("partition"))
    return groups.sticky_assignment(*group(spark, sf_dir), previous)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = stored.events(spark, sf_dir)
    state = F.when(F.col("event_type") == "error", "PREPARE_ABORT").when(F.col("event_type") == "signup", "PREPARE_COMMIT").when(F.col("event_type") == "purchase", "COMMITTED").otherwise("ONGOING")
    rows = topic.select("transaction_id", "ts", "event_id", F.col("timestamp").alias("since"), state.alias("state"))
    return topics.numbered(rows, ["ts", "event_id"], "seq", ("transaction_id",), F.floor(F.col("since") / topics.DAY))


_LATEST = f"WITH {EVENTS}, {STATES}, latest AS (SELECT transaction_id, arg_max(state, seq) AS state, max(since) AS since FROM states GROUP BY 1)"
TXN_NOW, TXN_MOST = 1_706_659_200_000, 3_600_000


@query("txn_latest_state", f"{_LATEST} SELECT * FROM latest")
def txn_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn.latest(_states(spark, sf_dir))


@query("txn_state_counts", f"{_LATEST} SELECT state, count(*) AS transactions FROM latest GROUP BY 1")
def txn_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn_latest_state(spark, sf_dir).groupBy("state").agg(F.count("*").alias("transactions"))


@query("txn_recovery", f"""{_LATEST} SELECT transaction_id, state, since, CASE WHEN state = 'PREPARE_COMMIT' THEN 'COMMIT' WHEN state = 'PREPARE_ABORT' THEN 'ABORT'
WHEN state NOT IN ('COMMITTED', 'ABORTED') AND {TXN_NOW} - since > {TXN_MOST} THEN 'ABORT' ELSE 'LEAVE' END AS action FROM latest""")
def txn_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn.recovery(txn_latest_state(spark, sf_dir), TXN_NOW, TXN_MOST)


_LEGAL = "'EMPTY>ONGOING', 'ONGOING>PREPARE_COMMIT', 'ONGOING>PREPARE_ABORT', 'PREPARE_COMMIT>COMMITTED', 'PREPARE_ABORT>ABORTED'"


@query("txn_illegal_transitions", f"WITH {EVENTS}, {STATES}, b AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY transaction_id ORDER BY seq), 'EMPTY') AS before FROM states) SELECT transaction_id, seq - 1 AS seq, before, state FROM b WHERE before || '>' || state NOT IN ({_LEGAL})")
def txn_illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn.illegal_steps(_states(spark, sf_dir)).select("transaction_id", "seq", "before", "state")


@query("txn_open", f"{_LATEST} SELECT transaction_id, state, since, {TXN_NOW} - since > {TXN_MOST} AS timed_out FROM latest WHERE state NOT IN ('COMMITTED', 'ABORTED')")
def txn_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: transactions that have not ended, and which of them took too long."""
    found = txn_latest_state(spark, sf_dir).where(~F.col("state").isin("COMMITTED", "ABORTED"))
    return found.withColumn("timed_out", scalar.timed_out(F.col("state"), F.col("since"), F.lit(TXN_NOW), TXN_MOST))


@query("txn_cleanup", f"{_LATEST} SELECT transaction_id FROM latest WHERE state IN ('COMMITTED', 'ABORTED') AND {TXN_NOW} - since > 86400000")
def txn_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: ended transactions older than a day, which are forgotten."""
    return txn_latest_state(spark, sf_dir).where(F.col("state").isin("COMMITTED", "ABORTED") & (TXN_NOW - F.col("since") > 86_400_000)).select("transaction_id")


@query("client_metrics", f"""WITH RECURSIVE {EVENTS}, {SEQUENCES} SELECT t.partition, count(*) AS records, CAST(sum(octet_length(encode(key)) + octet_length(encode(value))) AS BIGINT) AS bytes, count(*) FILTER (verdict = 'ACCEPT') AS accepted,
count(*) FILTER (verdict = 'DUPLICATE') AS duplicates, count(*) FILTER (verdict = 'GAP') AS gaps, count(*) FILTER (verdict = 'OLD') AS old FROM topic t JOIN checked c USING (event_id) GROUP BY 1""")
def client_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a producer's requests."""
    kinds = {"accepted": "ACCEPT", "duplicates": "DUPLICATE", "gaps": "GAP", "old": "OLD"}
    size = F.octet_length("key") + F.octet_length("value")
    return checked(spark, sf_dir).groupBy("partition").agg(F.count("*").alias("records"), F.sum(size).alias("bytes"), *(F.count_if(F.col("verdict") == v).alias(k) for k, v in kinds.items()))


@query("poll", f'WITH {EVENTS}, n AS (SELECT *, row_number() OVER (ORDER BY partition, "offset") AS n FROM topic WHERE partition IN (1, 4) AND "offset" >= 30) SELECT partition, "offset", key, value FROM n WHERE n <= 500')
def poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 500 records of the assigned partitions, which are drained in order."""
    topic = stored.events(spark, sf_dir).where(F.col("partition").isin(1, 4) & (F.col("offset") >= 30))
    return topic.orderBy("partition", "offset").limit(500).select(*_SHOWN)


@query("expired", f"""WITH {COMMITS} SELECT group_id, topic_partition, seq - 1 AS seq, {COMMITS_NOW} > expires AS offset_expired, {COMMITS_NOW} - (expires - {YEAR}) >= 86400000 AS batch_due,
{COMMITS_NOW} - (expires - {YEAR}) > 30000 AS member_expired, {COMMITS_NOW} - (expires - {YEAR}) >= 300000 AS metadata_stale FROM commits""")
def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which comparison includes its limit differs."""
    now, made = F.lit(COMMITS_NOW), F.col("expires") - YEAR
    return commits(spark, sf_dir).select(
        "group_id", "topic_partition", "seq", scalar.offset_expired(F.col("expires"), now).alias("offset_expired"), scalar.batch_due(made, now, 86_400_000).alias("batch_due"),
        scalar.member_expired(made, now, 30_000).alias("member_expired"), scalar.metadata_stale(made, now, 300_000).alias("metadata_stale"),
    )


@query("committed_state", f"""WITH RECURSIVE {EVENTS}, {SEQUENCES}, visible AS (SELECT h.partition, h."offset", h.key, h.value FROM topic h JOIN checked c ON c.event_id = h.event_id AND c.verdict = 'ACCEPT' WHERE h.marker IS NULL AND NOT {_HIDDEN.format(topic='topic', t='h')}),
latest AS (SELECT partition, key, min("offset") AS first, arg_max(value, "offset") AS value FROM visible GROUP BY 1, 2)
SELECT partition, key, row_number() OVER (PARTITION BY partition ORDER BY first) - 1 AS "offset", value FROM latest""")
def committed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: committed records of accepted sequence numbers, compacted to the latest of each key."""
    accepted = checked(spark, sf_dir).where("verdict = 'ACCEPT'")
    visible = txn.read_committed(accepted, markers=stored.events(spark, sf_dir))
    return storage.compact(visible.select("partition", "offset", "key", "value"))
