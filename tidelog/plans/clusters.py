"""Queries over brokers, replicas, votes, reassignments and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import scalar
from tidelog.operators import cluster, fold, topics
from tidelog.plans.registry import query
from tidelog.plans.sqltext import REPLICAS


@query("replica_placement", "WITH p AS (SELECT unnest(range(24)) AS p) SELECT CAST(p AS INTEGER) AS partition, CAST((p + 0) % 5 AS INTEGER) AS leader, CAST((p + 1) % 5 AS INTEGER) AS second, CAST((p + 2) % 5 AS INTEGER) AS third FROM p")
def replica_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(24).select(F.col("id").cast("int").alias("partition")).withColumn("r", cluster.placement(F.col("partition"), 5, 3))
    return rows.select("partition", *(F.col("r")[i].alias(n) for i, n in enumerate(("leader", "second", "third"))))


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = topics.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 8).cast("int").alias("partition")).agg(F.count("*").alias("leo"))
    each = ends.select("partition", "leo", F.posexplode(cluster.placement(F.col("partition"), 12, 3)).alias("i", "broker"))
    return each.select("partition", "broker", (F.col("i") == 0).alias("is_leader"), (F.col("leo") - F.col("i") * ((F.col("partition") * 7) % 9)).cast("long").alias("leo"))


@query("isr", f"WITH {REPLICAS} SELECT partition, broker, is_leader, leo, in_sync FROM rows_")
def isr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    return cluster.in_sync(replicas(spark, sf_dir)).select("partition", "broker", "is_leader", "leo", "in_sync")


@query("replica_lag", f"WITH {REPLICAS} SELECT partition, broker, leader_leo, leo, lag FROM rows_ WHERE NOT is_leader")
def replica_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.in_sync(replicas(spark, sf_dir)).where("NOT is_leader").select("partition", "broker", "leader_leo", "leo", "lag")


_HIGH = f"WITH {REPLICAS}, hw AS (SELECT partition, min(leo) FILTER (in_sync) AS high_watermark, count(*) FILTER (in_sync) AS isr, count(*) AS replicas FROM rows_ GROUP BY 1)"


@query("high_watermark", f"{_HIGH} SELECT * FROM hw")
def high_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.high_watermark(cluster.in_sync(replicas(spark, sf_dir)))


@query("under_replicated", f"{_HIGH} SELECT partition, isr, replicas FROM hw WHERE isr < replicas")
def under_replicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return high_watermark(spark, sf_dir).where("isr < replicas").select("partition", "isr", "replicas")


@query("ack_decision", f"""{_HIGH}, r AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS partition), q AS (SELECT partition, CAST(unnest([-1, 0, 1]) AS INTEGER) AS acks FROM r)
SELECT q.partition, acks, CAST(CASE WHEN isr IS NULL THEN 1 WHEN acks IN (0, 1) THEN CASE WHEN q.partition <> 5 THEN 0 ELSE 3 END WHEN q.partition = 5 THEN 3 WHEN isr < 2 THEN 4 WHEN high_watermark >= 7480 THEN 0 ELSE 2 END AS INTEGER) AS code
FROM q LEFT JOIN hw USING (partition)""")
def ack_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 for a target offset of 7480; broker of partition 5 has lost its lead, 8 and 9 don't exist."""
    asked = spark.range(10).select(F.col("id").cast("int").alias("partition")).withColumn("acks", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    rows = asked.join(high_watermark(spark, sf_dir), "partition", "left")
    return rows.select("partition", "acks", cluster.ack(F.col("acks"), F.col("partition") != 5, F.col("isr"), 2, F.col("high_watermark"), F.lit(7480)).alias("code"))


@query("isr_eviction", f"WITH {REPLICAS} SELECT partition, broker, leo, is_leader OR 20000 - (partition * 1700 + broker * 300) <= 10000 AS stays FROM rows_")
def isr_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: replicas that last fetched more than 10 s ago go; when each fetched is made up from its numbers."""
    fetched = F.col("partition") * 1700 + F.col("broker") * 300
    return replicas(spark, sf_dir).select("partition", "broker", "leo", (F.col("is_leader") | ~scalar.replica_lagging(fetched, F.lit(20_000), 10_000)).alias("stays"))


_STATE = "CASE s_suppkey % 5 WHEN 0 THEN 'STARTING' WHEN 4 THEN 'SHUTTING_DOWN' ELSE 'RUNNING' END"
_ALIVE = f"{_STATE} IN ('RUNNING', 'STARTING') AND 100000 - s_suppkey * 700 < 60000"


def _brokers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as brokers; heartbeat and state are made from the number."""
    k = F.col("s_suppkey")
    state = F.when(k % 5 == 0, "STARTING").when(k % 5 == 4, "SHUTTING_DOWN").otherwise("RUNNING")
    return topics.table(spark, sf_dir, "supplier").select(k.alias("broker"), F.col("s_nationkey").alias("rack"), state.alias("state"), (k * 700).alias("heartbeat"))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brokers(spark, sf_dir).where(scalar.broker_healthy(F.col("state"), F.col("heartbeat"), F.lit(100_000), 60_000))


@query("live_brokers", f"SELECT s_suppkey AS broker, s_nationkey AS rack, {_STATE} AS state FROM supplier WHERE {_ALIVE}")
def live_brokers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).select("broker", "rack", "state")


@query("controller_election", f"SELECT min(s_suppkey) AS controller FROM supplier WHERE {_ALIVE}")
def controller_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).agg(F.min("broker").alias("controller"))


@query("controller_placement", f"""WITH live AS (SELECT list(s_suppkey ORDER BY s_suppkey) AS l FROM supplier WHERE {_ALIVE}), a AS (SELECT unnest(range(12)) AS p, unnest([1, 2, 3, 5, 8, 100000, 1, 2, 3, 5, 8, 100000]) AS rf)
SELECT CAST(p AS INTEGER) AS partition, CAST(rf AS INTEGER) AS replicas, CASE WHEN len(l) >= rf THEN array_to_string(l[1:rf], ',') ELSE '' END AS brokers FROM a, live""")
def controller_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B13 as a controller does it: the first live brokers, or none where there are too few."""
    live = _live(spark, sf_dir).agg(F.array_sort(F.collect_set("broker")).alias("live"))  # the brokers of a cluster
    sizes = F.array(*map(F.lit, (1, 2, 3, 5, 8, 100_000)))
    rows = spark.range(12).select(F.col("id").cast("int").alias("partition"), sizes[(F.col("id") % 6).cast("int")].alias("replicas")).join(F.broadcast(live))
    placed = cluster.live_placement(F.col("live"), F.col("replicas"))
    return rows.select("partition", "replicas", F.array_join(F.transform(placed, lambda b: b.cast("string")), ",").alias("brokers"))


@query("leader_election", f"""WITH live AS (SELECT s_suppkey AS b FROM supplier WHERE {_ALIVE}), p AS (SELECT unnest(range(100)) AS p),
r AS (SELECT p, (p + i) % 100 AS b, i FROM p, (SELECT unnest(range(3)) AS i)),
c AS (SELECT p, arg_min(r.b, r.i) FILTER (live.b IS NOT NULL AND r.i < 2) AS clean, arg_min(r.b, r.i) FILTER (live.b IS NOT NULL) AS dirty FROM r LEFT JOIN live ON r.b = live.b GROUP BY 1)
SELECT CAST(p AS INTEGER) AS partition, CAST(clean AS INTEGER) AS clean, CAST(coalesce(clean, dirty) AS INTEGER) AS unclean FROM c""")
def leader_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicas by placement over 100 brokers, the first two in sync."""
    live = _live(spark, sf_dir).agg(F.collect_set(F.col("broker").cast("int")).alias("live"))  # the brokers of a cluster
    rows = spark.range(100).select(F.col("id").cast("int").alias("partition")).withColumn("r", cluster.placement(F.col("partition"), 100, 3)).join(F.broadcast(live))
    elect = lambda unclean: cluster.elect(F.slice("r", 1, 2), F.col("r"), F.col("live"), unclean)
    return rows.select("partition", elect(False).alias("clean"), elect(True).alias("unclean"))


@query("partitions_of_broker", "WITH p AS (SELECT unnest(range(24)) AS p), r AS (SELECT p, (p + i) % 5 AS b, i FROM p, (SELECT unnest(range(3)) AS i)) SELECT CAST(b AS INTEGER) AS broker, count(*) AS partitions, count(*) FILTER (i = 0) AS leads FROM r GROUP BY 1")
def partitions_of_broker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3."""
    rows = spark.range(24).select(F.posexplode(cluster.placement(F.col("id").cast("int"), 5, 3)).alias("i", "broker"))
    return rows.groupBy("broker").agg(F.count("*").alias("partitions"), F.sum((F.col("i") == 0).cast("long")).alias("leads"))


_MATCH = """m AS (SELECT s_nationkey AS cluster, s_suppkey AS node, s_suppkey * 37 % 50 AS match_index, CASE WHEN s_suppkey % 3 = 0 THEN 6 ELSE 7 END AS entry_term FROM supplier),
o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY match_index, entry_term) AS r, count(*) OVER (PARTITION BY cluster) AS n FROM m)"""


@query("raft_commit_index", f"WITH {_MATCH} SELECT cluster, match_index AS candidate, CASE WHEN entry_term = 7 THEN match_index END AS commit_index FROM o WHERE r = (n - 1) // 2 + 1")
def raft_commit_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as clusters of suppliers."""
    k = F.col("s_suppkey")
    rows = topics.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("cluster"), k.alias("node"), (k * 37 % 50).alias("match_index"), F.when(k % 3 == 0, 6).otherwise(7).alias("entry_term"))
    return cluster.commit_index(rows, "cluster", 7)


@query("vote_tally", "SELECT s_nationkey AS cluster, count(*) FILTER (s_suppkey % 3 <> 0) + 1 AS votes, count(*) AS peers, count(*) FILTER (s_suppkey % 3 <> 0) + 1 >= (count(*) + 1) // 2 + 1 AS elected FROM supplier GROUP BY 1")
def vote_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate and its peers."""
    rows = topics.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("cluster")).agg((F.sum((F.col("s_suppkey") % 3 != 0).cast("long")) + 1).alias("votes"), F.count("*").alias("peers"))
    return rows.withColumn("elected", F.col("votes") >= F.floor((F.col("peers") + 1) / 2) + 1)


_LEADER = "leader AS (SELECT c_nationkey AS node, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS index, c_nationkey % 3 + 2 AS term FROM customer)"
_FOLLOWER = "sized AS (SELECT *, count(*) OVER (PARTITION BY node) AS size FROM leader), follower AS (SELECT node, index, CASE WHEN 5 * index > 3 * size + node THEN 1 ELSE term END AS term FROM sized WHERE 5 * index <= 4 * size)"


@query("log_conflict", f"""WITH {_LEADER}, {_FOLLOWER}, b AS (SELECT coalesce(l.node, f.node) AS node, coalesce(l.index, f.index) AS index, l.term AS lt, f.term AS ft FROM leader l FULL JOIN follower f ON l.node = f.node AND l.index = f.index),
c AS (SELECT *, min(CASE WHEN lt <> ft THEN index END) OVER (PARTITION BY node) AS first FROM b)
SELECT node, index, CAST(CASE WHEN ft IS NOT NULL AND (first IS NULL OR index < first) THEN ft ELSE lt END AS INTEGER) AS term, CASE WHEN ft IS NOT NULL AND (first IS NULL OR index < first) THEN 'kept' ELSE 'appended' END AS "from" FROM c""")
def log_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A follower's log after the leader's entries; it has four fifths of them, and from about three fifths on others."""
    c = topics.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("node"), "c_custkey")
    leader = topics.numbered(c, ["c_custkey"], "index", ("node",)).select("node", (F.col("index") + 1).alias("index"), (F.col("node") % 3 + 2).cast("int").alias("term"))
    sized = leader.join(leader.groupBy("node").agg(F.count("*").alias("size")), "node").where("5 * index <= 4 * size")
    follower = sized.select("node", "index", F.when(F.expr("5 * index > 3 * size + node"), 1).otherwise(F.col("term")).alias("term"))
    return cluster.log_conflict(leader, follower)


_MOVES = "moves AS (SELECT s_suppkey AS id, [s_suppkey % 5, (s_suppkey + 1) % 5, (s_suppkey + 2) % 5] AS old, [(s_suppkey + 2) % 7, (s_suppkey + 3) % 7, s_suppkey % 5] AS new FROM supplier)"


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("int")
    return topics.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(k % 5, (k + 1) % 5, (k + 2) % 5).alias("old"), F.array((k + 2) % 7, (k + 3) % 7, k % 5).alias("new"))


@query("reassignment_diff", f"WITH {_MOVES} SELECT id, array_to_string(list_filter(list_distinct_in_order, lambda x: NOT list_contains(old, x)), ',') AS add, array_to_string(list_filter(old, lambda x: NOT list_contains(new, x)), ',') AS remove FROM (SELECT *, [new[1], new[2]] || CASE WHEN list_contains([new[1], new[2]], new[3]) THEN [] ELSE [new[3]] END AS list_distinct_in_order FROM moves)")
def reassignment_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """replicas to add and to remove, in order."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return _moves(spark, sf_dir).select("id", joined(F.array_except("new", "old")).alias("add"), joined(F.array_except("old", "new")).alias("remove"))


@query("reassignment_progress", """SELECT s_suppkey AS id, CAST(30 + least(30, CAST(trunc(30 * (1 - (s_suppkey * 13 % 150) / 100.0::DOUBLE)) AS INTEGER)) AS INTEGER) AS progress,
round(CASE WHEN s_suppkey % 90 > 0 THEN 5000 * 100.0::DOUBLE / (s_suppkey % 90) - 5000 END, 6) AS eta,
CASE WHEN s_suppkey % 7 = 0 THEN 'FAILED' WHEN s_suppkey % 4 = 0 THEN 'ADDING_REPLICAS' WHEN s_suppkey % 4 = 1 THEN 'WAITING_CATCHUP' WHEN s_suppkey % 4 = 2 THEN 'REMOVING_REPLICAS' ELSE 'COMPLETED' END AS next FROM supplier""")
def reassignment_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20, F21, B20."""
    k = F.col("s_suppkey")
    phase = F.element_at(F.array(*map(F.lit, ("PENDING", "ADDING_REPLICAS", "WAITING_CATCHUP", "REMOVING_REPLICAS"))), (k % 4 + 1).cast("int"))
    return topics.table(spark, sf_dir, "supplier").select(
        k.alias("id"), scalar.catch_up_progress(k * 13 % 150).alias("progress"), F.round(scalar.eta(F.lit(5000), k % 90), 6).alias("eta"), scalar.next_phase(phase, k % 7 != 0).alias("next")
    )


@query("reassignment_summary", "SELECT CASE s_suppkey % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'ADDING_REPLICAS' WHEN 2 THEN 'WAITING_CATCHUP' ELSE 'REMOVING_REPLICAS' END AS phase, count(*) AS moves, CAST(sum(s_suppkey * 1000) AS BIGINT) AS bytes FROM supplier GROUP BY 1")
def reassignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    phase = F.when(k % 4 == 0, "PENDING").when(k % 4 == 1, "ADDING_REPLICAS").when(k % 4 == 2, "WAITING_CATCHUP").otherwise("REMOVING_REPLICAS")
    return topics.table(spark, sf_dir, "supplier").groupBy(phase.alias("phase")).agg(F.count("*").alias("moves"), F.sum(k * 1000).alias("bytes"))


_UPDATES = "u AS (SELECT event_id, CAST(user_id % 6 AS INTEGER) AS cluster, CAST(user_id % 30 AS INTEGER) AS partition, CAST(event_id // 50 - CASE WHEN event_id % 9 = 0 THEN 3 ELSE 0 END AS BIGINT) AS epoch, user_id AS leader FROM events)"


@query("metadata_epoch_filter", f"""WITH {_UPDATES}, h AS (SELECT *, max(epoch) OVER (PARTITION BY cluster ORDER BY event_id) AS highest FROM u)
SELECT cluster, partition, arg_max(epoch, event_id) AS epoch, arg_max(leader, event_id) AS leader FROM h WHERE epoch >= highest GROUP BY 1, 2""")
def metadata_epoch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale updates are refused, the latest of the others stands."""
    u, k = F.col("user_id"), F.col("event_id")
    epoch = F.floor(k / 50) - F.when(k % 9 == 0, 3).otherwise(0)
    rows = topics.table(spark, sf_dir, "events").select("event_id", (u % 6).cast("int").alias("cluster"), (u % 30).cast("int").alias("partition"), epoch.cast("long").alias("epoch"), u.alias("leader"))
    return cluster.epoch_filter(rows, ["cluster", "partition"], "event_id")


@query("metadata_cache", f"""WITH {_UPDATES}, l AS (SELECT cluster, partition, max(u.event_id) AS at FROM u GROUP BY 1, 2)
SELECT l.cluster, l.partition, u.leader, epoch_us(e.ts) // 1000 AS loaded, 1706659200000 - epoch_us(e.ts) // 1000 < 300000 AS fresh FROM l JOIN u ON u.event_id = l.at JOIN events e ON e.event_id = l.at""")
def metadata_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached leader of each partition, and whether it may be used as it is: five minutes after it was loaded it may not."""
    e = topics.table(spark, sf_dir, "events")
    u = F.col("user_id")
    rows = e.select("event_id", (u % 6).cast("int").alias("cluster"), (u % 30).cast("int").alias("partition"), u.alias("leader"), topics.millis("ts", e).alias("loaded"))
    last = rows.groupBy("cluster", "partition").agg(F.max_by(F.struct("leader", "loaded"), "event_id").alias("x")).select("cluster", "partition", "x.leader", "x.loaded")
    return last.withColumn("fresh", ~scalar.metadata_stale(F.col("loaded"), F.lit(1_706_659_200_000), 300_000))


_CALLS = "calls AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, event_type <> 'error' AS ok, CAST(round(value * 100) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = topics.table(spark, sf_dir, "events")
    rows = e.select("user_id", "event_id", topics.millis("ts", e).alias("ms"), (F.col("event_type") != "error").alias("ok"), F.round(F.col("value") * 100).cast("long").alias("bytes"), "ts")
    return topics.numbered(rows, ["ts", "event_id"], "n", ("user_id",)).drop("ts")


@query("throttle_schedule", f"""WITH RECURSIVE {_CALLS}, f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS tokens, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS goes FROM (SELECT DISTINCT user_id FROM calls)
  UNION ALL
  SELECT user_id, n, event_id, CASE WHEN bytes > 5000 THEN tokens ELSE least(5000000, filled + wait * 5000) - 1000 * bytes END, CASE WHEN bytes > 5000 THEN last ELSE now + wait END, CASE WHEN bytes > 5000 THEN NULL ELSE now + wait END FROM (
    SELECT *, greatest(0, (1000 * bytes - filled + 4999) // 5000) AS wait FROM (
      SELECT *, CASE WHEN last IS NULL THEN tokens ELSE least(5000000, tokens + (now - last) * 5000) END AS filled FROM (
        SELECT c.user_id, c.n, c.event_id, c.bytes, f.tokens, f.last, CASE WHEN f.last IS NULL THEN c.ms ELSE greatest(c.ms, f.last) END AS now FROM f JOIN calls c ON c.user_id = f.user_id AND c.n = f.n + 1))))
SELECT event_id, goes FROM f WHERE n > 0""")
def throttle_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each request may go at 5000 bytes a second; null for one that is too large."""
    return fold.ordered_fold(_calls(spark, sf_dir), ["user_id"], ["n"], ["ms", "bytes"], *fold.token_bucket(5000), "goes long").select("event_id", "goes")


@query("throttle_two_level")
def throttle_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each request may go by a limit for all and then one for its partition; compared with a plain loop on a small table.

    The limit for all makes one order of all requests, and a partition's makes one of an eighth of them; both are folded in
    stretches. Those of the partitions are between the times at which the stretches of all have ended.
    """
    e = topics.table(spark, sf_dir, "events")
    rows = e.select("event_id", (F.col("user_id") % 8).cast("int").alias("partition"), topics.millis("ts", e).alias("ms"), F.round(F.col("value") * 100).cast("long").alias("bytes"))
    tasks = 1 + rows.count() // topics.FOLDED
    rows = topics.stretched(rows, F.floor(F.col("ms") / 60_000), "stretch", topics.FOLDED)
    first = fold.stretched_bucket(rows, [], "stretch", ["ms", "event_id"], ("ms", "bytes"), 20_000, "global_goes", tasks)
    both = fold.stretched_bucket(first.where("global_goes IS NOT NULL"), ["partition"], "stretch", ["global_goes", "event_id"], ("global_goes", "bytes"), 5000, "goes", tasks)
    return both.select("event_id", "partition", "global_goes", "goes")


@query("throttle_metrics", f"""WITH RECURSIVE {_CALLS}, f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ms, CAST(0 AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS tokens, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS goes FROM (SELECT DISTINCT user_id FROM calls)
  UNION ALL
  SELECT user_id, n, ms, bytes, CASE WHEN bytes > 5000 THEN tokens ELSE least(5000000, filled + wait * 5000) - 1000 * bytes END, CASE WHEN bytes > 5000 THEN last ELSE now + wait END, CASE WHEN bytes > 5000 THEN NULL ELSE now + wait END FROM (
    SELECT *, greatest(0, (1000 * bytes - filled + 4999) // 5000) AS wait FROM (
      SELECT *, CASE WHEN last IS NULL THEN tokens ELSE least(5000000, tokens + (now - last) * 5000) END AS filled FROM (
        SELECT c.user_id, c.n, c.ms, c.bytes, f.tokens, f.last, CASE WHEN f.last IS NULL THEN c.ms ELSE greatest(c.ms, f.last) END AS now FROM f JOIN calls c ON c.user_id = f.user_id AND c.n = f.n + 1))))
SELECT user_id, count(goes) AS went, count(*) - count(goes) AS refused, CAST(coalesce(sum(bytes) FILTER (goes IS NOT NULL), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(goes - ms), 0) AS BIGINT) AS waited_ms FROM f WHERE n > 0 GROUP BY 1""")
def throttle_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a throttle let through for each user, and how long that waited."""
    rows = fold.ordered_fold(_calls(spark, sf_dir), ["user_id"], ["n"], ["ms", "bytes"], *fold.token_bucket(5000), "goes long")
    went = F.col("goes").isNotNull()
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.groupBy("user_id").agg(F.count("goes").alias("went"), F.count_if(~went).alias("refused"), zero(F.when(went, F.col("bytes"))).alias("bytes"), zero(F.col("goes") - F.col("ms")).alias("waited_ms"))


@query("circuit_breaker", f"""WITH RECURSIVE {_CALLS}, f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, 'CLOSED' AS name, 0 AS failed, 0 AS went, CAST(0 AS BIGINT) AS last, 'CLOSED' AS before, TRUE AS let FROM (SELECT DISTINCT user_id FROM calls)
  UNION ALL
  SELECT user_id, n, event_id,
    CASE WHEN let AND ok AND before = 'HALF_OPEN' AND went + 1 >= 2 THEN 'CLOSED' WHEN let AND NOT ok AND failed + 1 >= 2 THEN 'OPEN' ELSE before END,
    CASE WHEN let AND ok THEN 0 WHEN let THEN failed + 1 ELSE failed END,
    CASE WHEN let AND ok AND before = 'HALF_OPEN' THEN CASE WHEN went + 1 >= 2 THEN 0 ELSE went + 1 END ELSE went END,
    CASE WHEN let AND NOT ok THEN ms ELSE last END, before, let FROM (
    SELECT *, before <> 'OPEN' AS let FROM (
      SELECT c.user_id, c.n, c.event_id, c.ms, c.ok, f.last, f.failed, f.went, CASE WHEN f.name = 'OPEN' AND c.ms - f.last >= 21600000 THEN 'HALF_OPEN' ELSE f.name END AS before
      FROM f JOIN calls c ON c.user_id = f.user_id AND c.n = f.n + 1)))
SELECT event_id, before, let, name AS after FROM f WHERE n > 0""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opens after two failures for six hours from the last, closes after two successes."""
    return fold.ordered_fold(_calls(spark, sf_dir), ["user_id"], ["n"], ["ms", "ok"], *fold.circuit_breaker(2, 21_600_000, 2), "before string, let boolean, after string").select("event_id", "before", "let", "after")


_COMMANDS = """commands AS (SELECT event_id // 1000 AS term, event_id AS index, CASE WHEN event_type IN ('signup', 'error') THEN 'broker' WHEN event_type = 'view' THEN 'leader' ELSE 'topic' END AS kind,
CASE WHEN event_type IN ('signup', 'error') THEN user_id ELSE user_id % 20 END AS key, CASE WHEN event_type IN ('error', 'click') THEN NULL ELSE user_id END AS value FROM events)"""


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as replicated commands: brokers come (signup) and go (error), topics are made (purchase) and deleted (click), leaders are set (view)."""
    kind, user = F.col("event_type"), F.col("user_id")
    broker = kind.isin("signup", "error")
    return topics.table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 1000).alias("term"), F.col("event_id").alias("index"), F.when(broker, "broker").when(kind == "view", "leader").otherwise("topic").alias("kind"),
        F.when(broker, user).otherwise(user % 20).alias("key"), F.when(kind.isin("error", "click"), None).otherwise(user).alias("value"),
    )


@query("raft_apply", f"WITH {_COMMANDS}, s AS (SELECT kind, key, arg_max(struct_pack(v := value, i := index), (term, index)) AS x FROM commands GROUP BY 1, 2) SELECT kind, key, x.v AS value, x.i AS index FROM s WHERE x.v IS NOT NULL")
def raft_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after all commands; the last command on a key decides, an empty one removes it."""
    last = _commands(spark, sf_dir).groupBy("kind", "key").agg(F.max_by(F.struct("value", "index"), F.struct("term", "index")).alias("x"))
    return last.where("x.value IS NOT NULL").select("kind", "key", "x.value", "x.index")


@query("leader_routing", f"WITH {REPLICAS} SELECT CAST(l_suppkey % 8 AS INTEGER) AS partition, r.broker, count(*) AS requests FROM lineitem JOIN rows_ r ON r.partition = l_suppkey % 8 AND r.is_leader GROUP BY 1, 2")
def leader_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests go to their partition's leader."""
    leaders = replicas(spark, sf_dir).where("is_leader").select("partition", "broker")
    asked = topics.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 8).cast("int").alias("partition")).agg(F.count("*").alias("requests"))
    return asked.join(leaders, "partition").select("partition", "broker", "requests")
