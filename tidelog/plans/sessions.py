"""Queries over producers, groups, documents and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import documents
from tidelog.operators import groups, offsets, sessions, topics
from tidelog.plans import state, stored
from tidelog.plans.registry import query
from tidelog.plans.sqltext import COMMITS, EVENTS, MEMBERS, REPLICAS, SEQUENCES

PID_TIMEOUT, PID_START = 6 * 3_600_000, (1 << 31) - 100

_PIDS = f"""requests AS (SELECT event_id AS n, user_id AS client, epoch_us(ts) // 1000 AS ms FROM events),
gaps AS (SELECT *, ms - lag(ms) OVER (PARTITION BY client ORDER BY ms, n) AS gap FROM requests),
marked AS (SELECT *, coalesce(gap <= {PID_TIMEOUT}, FALSE) AS reused FROM gaps),
numbered AS (SELECT *, CASE WHEN NOT reused THEN sum(CASE WHEN reused THEN 0 ELSE 1 END) OVER (ORDER BY ms, n) - 1 END AS nth FROM marked),
given AS (SELECT n, client, ms, reused, CAST((last_value(nth IGNORE NULLS) OVER (PARTITION BY client ORDER BY ms, n) + {PID_START}) % 2147483648 AS BIGINT) AS producer_id FROM numbered)"""


def _pids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = topics.table(spark, sf_dir, "events")
    return sessions.producer_ids(e.select(F.col("event_id").alias("n"), F.col("user_id").alias("client"), topics.millis("ts", e).alias("at")), PID_TIMEOUT, PID_START)


@query("pid_requests", f"WITH {_PIDS} SELECT n, client, producer_id, reused FROM given")
def pid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that are used again within six hours, else the next one, round at 2**31."""
    return _pids(spark, sf_dir).select("n", "client", "producer_id", "reused")


@query("pid_metrics", f"WITH {_PIDS} SELECT count(*) AS requests, count(DISTINCT producer_id) AS assigned, count(DISTINCT producer_id) FILTER (ms >= {state.TXN_NOW - PID_TIMEOUT}) AS active, count(*) FILTER (reused) AS reused FROM given")
def pid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of producer ids."""
    rows = _pids(spark, sf_dir)
    return rows.agg(F.count("*").alias("requests"), F.count_distinct("producer_id").alias("assigned"), F.count_distinct(F.when(F.col("at") >= state.TXN_NOW - PID_TIMEOUT, F.col("producer_id"))).alias("active"), F.count_if("reused").alias("reused"))


@query("seq_last", f"""WITH RECURSIVE {EVENTS}, {SEQUENCES} SELECT c.user_id, max(c.seq) AS last_sequence, arg_max(t."offset", c.n) AS last_offset FROM checked c JOIN topic t USING (event_id)
WHERE verdict = 'ACCEPT' AND c.user_id % 10 <> 9 GROUP BY 1""")
def seq_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sequence number and offset of each producer; those whose number ends in 9 have been cleaned up."""
    return sessions.last_sequences(state.checked(spark, sf_dir).where("user_id % 10 <> 9"), ["user_id"])


@query("seq_duplicates", f"""WITH RECURSIVE {EVENTS}, {SEQUENCES}, x AS (SELECT c.*, t."offset" FROM checked c JOIN topic t USING (event_id))
SELECT d.event_id, d.seq, arg_max(a."offset", a.n) AS "of" FROM x d JOIN x a ON a.user_id = d.user_id AND a.n < d.n AND a.verdict = 'ACCEPT' WHERE d.verdict = 'DUPLICATE' GROUP BY 1, 2""")
def seq_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which offset a refused repetition is answered with."""
    return sessions.duplicates(state.checked(spark, sf_dir), ["user_id"]).select("event_id", "seq", "of")


_LOG = """log AS (SELECT CAST(user_id % 6 AS INTEGER) AS "group", user_id AS member, event_id AS n, CASE event_type WHEN 'signup' THEN 'join' WHEN 'error' THEN 'leave' ELSE 'beat' END AS kind FROM events),
was AS (SELECT *, coalesce(last_value(CASE WHEN kind <> 'beat' THEN kind END IGNORE NULLS) OVER (PARTITION BY "group", member ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'join', FALSE) AS was_in FROM log),
changed AS (SELECT *, (kind = 'join' AND NOT was_in) OR (kind = 'leave' AND was_in) AS changes FROM was),
made AS (SELECT *, CAST(sum(CASE WHEN changes THEN 1 ELSE 0 END) OVER (PARTITION BY "group" ORDER BY n) AS BIGINT) AS generation FROM changed)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "join").when(F.col("event_type") == "error", "leave").otherwise("beat")
    return topics.table(spark, sf_dir, "events").select((F.col("user_id") % 6).cast("int").alias("group"), F.col("user_id").alias("member"), F.col("event_id").alias("n"), kind.alias("kind"))


@query("group_generations", f'WITH {_LOG} SELECT n, "group", member, kind, generation FROM made')
def group_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generation of each group after each join, leave and heartbeat."""
    return sessions.generations(_log(spark, sf_dir)).select("n", "group", "member", "kind", "generation")


@query("group_fencing", f"""WITH {_LOG}, known AS (SELECT *, last_value(CASE WHEN kind = 'join' THEN generation END IGNORE NULLS) OVER (PARTITION BY "group", member ORDER BY n) AS knows FROM made)
SELECT n, "group", member, CASE WHEN NOT was_in THEN 'unknown' WHEN knows <> generation THEN 'fenced' ELSE 'ok' END AS answer FROM known WHERE kind = 'beat'""")
def group_fencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each heartbeat is answered."""
    return sessions.fenced(_log(spark, sf_dir)).select("n", "group", "member", "answer")


@query("group_members", f"""WITH {_LOG}, s AS (SELECT "group", member, arg_max(kind, n) AS kind, max(CASE WHEN changes AND kind = 'join' THEN n END) AS since FROM made WHERE kind <> 'beat' GROUP BY 1, 2),
g AS (SELECT "group", max(generation) AS generation FROM made GROUP BY 1)
SELECT "group", member, generation, row_number() OVER (PARTITION BY "group" ORDER BY since, member) = 1 AS leader FROM s JOIN g USING ("group") WHERE kind = 'join'""")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of each group at the end, and who leads it."""
    return sessions.members(_log(spark, sf_dir))


@query("rebalance_difference", f"""WITH {MEMBERS}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY member) - 1 AS r, count(*) OVER (PARTITION BY topic) AS m FROM subs JOIN counts USING (topic)),
s AS (SELECT topic, member, r * (partitions // m) + least(r, partitions % m) AS start, partitions // m + CASE WHEN r < partitions % m THEN 1 ELSE 0 END AS n FROM r),
new AS (SELECT topic, CAST(unnest(range(start, start + n)) AS INTEGER) AS partition, member FROM s),
old AS (SELECT c_mktsegment AS topic, CAST(c_custkey % 4 AS INTEGER) AS partition, min('m' || c_custkey) AS member FROM customer GROUP BY 1, 2)
SELECT *, 'revoke' AS step FROM (SELECT * FROM old EXCEPT SELECT * FROM new) UNION ALL SELECT *, 'assign' FROM (SELECT * FROM new EXCEPT SELECT * FROM old)""")
def rebalance_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes hands when ranges take the place of an older assignment."""
    c = topics.table(spark, sf_dir, "customer")
    old = c.groupBy(F.col("c_mktsegment").alias("topic"), (F.col("c_custkey") % 4).cast("int").alias("partition")).agg(F.min(F.concat(F.lit("m"), F.col("c_custkey").cast("string"))).alias("member"))
    return groups.handed_over(old, groups.range_assignment(*state.group(spark, sf_dir)))


_CURRENT = f"""WITH {COMMITS}, {{more}} last AS (SELECT group_id, topic_partition, arg_max(struct_pack(c := committed, e := expires), seq) AS l FROM {{rows}} GROUP BY 1, 2),
current AS (SELECT group_id, topic_partition, l.c AS committed FROM last WHERE l.c IS NOT NULL AND l.e >= {state.COMMITS_NOW})"""


@query("offsets_after_delete", f"""{_CURRENT.format(more="gone AS (SELECT group_id, topic_partition, committed, expires, seq FROM commits UNION ALL SELECT group_id, topic_partition, NULL, max(expires), max(seq) + 1 FROM commits WHERE group_id = '1-URGENT' GROUP BY 1, 2),", rows='gone')} SELECT * FROM current""")
def offsets_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2-A4: the committed offsets after one group has been deleted."""
    return offsets.current(offsets.deleted(state.commits(spark, sf_dir), "1-URGENT"), state.COMMITS_NOW)


_ASSIGNED = "asked AS (SELECT DISTINCT o_orderpriority AS group_id FROM orders), assigned AS (SELECT group_id, CAST(unnest(range(10)) AS INTEGER) AS topic_partition FROM asked)"


def _starts(spark: SparkSession, sf_dir: str, reset: str) -> DataFrame:
    committed = offsets.current(state.commits(spark, sf_dir), state.COMMITS_NOW)
    return offsets.start_offsets(state.assigned(spark, sf_dir), committed, state.ends(spark, sf_dir), reset, report=True)


@query("reset_earliest", f"{_CURRENT.format(more='', rows='commits')}, {_ASSIGNED} SELECT a.group_id, a.topic_partition, coalesce(committed, 0) AS start, CASE WHEN committed IS NOT NULL THEN 'committed' ELSE 'earliest' END AS how FROM assigned a LEFT JOIN current c ON a.group_id = c.group_id AND a.topic_partition = c.topic_partition")
def reset_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: commits, else the beginning."""
    return _starts(spark, sf_dir, "earliest")


@query("reset_none", f"{_CURRENT.format(more='', rows='commits')}, {_ASSIGNED} SELECT a.group_id, a.topic_partition, committed AS start, CASE WHEN committed IS NOT NULL THEN 'committed' ELSE 'error' END AS how FROM assigned a LEFT JOIN current c ON a.group_id = c.group_id AND a.topic_partition = c.topic_partition")
def reset_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: commits, else an error, here as a row that says so."""
    return _starts(spark, sf_dir, "none")


@query("transaction_json", f"""WITH {EVENTS} SELECT transaction_id, user_id AS producer_id, CAST(event_id % 3 AS INTEGER) AS producer_epoch, coalesce(marker, 'ONGOING') AS state, partition, timestamp,
CASE WHEN event_id % 2 = 0 THEN 30000 ELSE 60000 END AS timeout_ms FROM topic""")
def transaction_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: entries of the transaction log as documents and back; half of them don't say how long they may take."""
    t, e = stored.events(spark, sf_dir), F.col("event_id")
    parts = F.array(F.struct(F.lit("events").alias("topic"), F.col("partition")))
    value = F.struct("transaction_id", "user_id", (e % 3).cast("int"), F.coalesce("marker", F.lit("ONGOING")), parts, "timestamp", F.when(e % 2 == 0, 30_000).cast("long"))
    text = t.select(documents.to_json("transaction", value).alias("json"))
    x = text.select(documents.from_json("transaction", F.col("json")).alias("x"))
    return x.select("x.transaction_id", "x.producer_id", "x.producer_epoch", "x.state", F.col("x.partitions")[0]["partition"].alias("partition"), "x.timestamp", F.col("x.timeout_ms").alias("timeout_ms"))


@query("topic_json", f"WITH {REPLICAS} SELECT 'lineitem' AS name, 8 AS num_partitions, 604800000 AS segment_ms, partition, CAST(min(broker) FILTER (is_leader) AS INTEGER) AS leader, count(*) AS replicas, count(*) FILTER (in_sync) AS isr FROM rows_ GROUP BY partition")
def topic_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: a topic with its partitions as one document and back."""
    from tidelog.operators import cluster
    from tidelog.plans.clusters import replicas

    rows = cluster.in_sync(replicas(spark, sf_dir))
    each = rows.groupBy("partition").agg(F.min(F.when(F.col("is_leader"), F.col("broker"))).alias("leader"), F.collect_list("broker").alias("replicas"), F.collect_list(F.when(F.col("in_sync"), F.col("broker"))).alias("isr"))
    parts = F.collect_list(F.struct(F.lit("lineitem"), "partition", "leader", "replicas", "isr"))  # the partitions of a topic
    config = F.struct(F.lit("lineitem"), F.lit(8), F.lit(3), F.lit(-1), F.lit(-1), F.lit(1 << 30), F.lit(604_800_000))
    text = each.agg(parts.alias("parts")).select(documents.to_json("topic", F.struct(config, "parts")).alias("json"))
    x = text.select(documents.from_json("topic", F.col("json")).alias("x")).select("x.config.*", F.explode("x.partitions").alias("p"))
    return x.select("name", "num_partitions", "segment_ms", "p.partition", "p.leader", F.size("p.replicas").cast("long").alias("replicas"), F.size("p.isr").cast("long").alias("isr"))


@query("broker_json", "SELECT CAST(s_suppkey AS INTEGER) AS broker_id, s_name AS host, CAST(9092 + s_suppkey % 3 AS INTEGER) AS port, CASE WHEN s_nationkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) END AS rack, 'starting' AS state, 0 AS registered_at, s_suppkey * 700 AS last_heartbeat FROM supplier")
def broker_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: brokers as documents and back; what they don't say has its default."""
    k, nation = F.col("s_suppkey"), F.col("s_nationkey")
    value = F.struct(k.cast("int"), "s_name", (9092 + k % 3).cast("int"), F.when(nation % 2 == 0, nation.cast("string")), F.lit(None).cast("string"), F.lit(None).cast("long"), k * 700)
    text = topics.table(spark, sf_dir, "supplier").select(documents.to_json("broker", value).alias("json"))
    return text.select(documents.from_json("broker", F.col("json")).alias("x")).select("x.*")


@query("consumer_metrics", f'WITH {EVENTS} SELECT partition, count(*) AS records, CAST(sum(octet_length(encode(key)) + octet_length(encode(value))) AS BIGINT) AS bytes, CAST(ceil(count(*) / 500) AS BIGINT) AS polls, max("offset") + 1 AS position FROM topic GROUP BY 1')
def consumer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a consumer that reads each partition in polls of 500."""
    size = F.octet_length("key") + F.octet_length("value")
    return stored.events(spark, sf_dir).groupBy("partition").agg(F.count("*").alias("records"), F.sum(size).alias("bytes"), F.ceil(F.count("*") / 500).cast("long").alias("polls"), (F.max("offset") + 1).alias("position"))
