"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are numbered and cut into blocks. In the even flow that the schedule follows,
the sources that still have blocks share each slot in the ratio of their target weights; where one
is used up the others' weights are scaled up to 1 (a phase ends). A block may be released from the
slot in which the flow begins it and is due by the end of the slot in which the flow ends it: in the
first phase, with target weight w, block k from slot floor(k / w) on and by slot ceil((k + 1) / w).
In each slot the earliest deadline among the released blocks goes (EDF). The flow fills every slot,
so EDF meets every deadline, and after any slot of the whole mix each source has had as many blocks
as the flow gave it, give or take less than one.

Weights are exact: a float is the decimal that it prints as, and all arithmetic is on whole numbers.
The schedule is a fold over the slots by definition; the driver makes it from the sizes alone, for
any number of sources, with a size and a weight for each and 8 bytes a block, and each row finds its
block's slot by a join on its source and a stretch of blocks. Blocks have BLOCK rows, or as many more
as keep them to BLOCKS (and one a source) on very large tables. No row is dropped or repeated.

Rows of a source go by a hash of their key. They are numbered in parts, stretches of that hash which
have about PART rows of the largest source, so no task holds a whole source; only rows with one and
the same key stay in one part. Rows are worked on by DataFrame and SQL functions only.

Defined results: a null source is a source of its own, named `unknown`; sources without a target
weight get weight 0 and follow when the weighted ones are used up, in equal shares; null keys are one
key; rows with one key get neighbouring places in any order; texts of any length are carried whole; an
empty table gives no rows; columns of any name are carried along, but for `mix_block`, `mix_slot` and
`mix_row`, which are replaced.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import defaultdict
from fractions import Fraction
from functools import reduce
from heapq import heappop, heappush
from itertools import accumulate
from math import gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.tables import quoted, table

#: Least rows of a block, blocks up to which there are so many; rows of a part; blocks in a row of the schedule; blocks, and rows of the table of parts, up to which these are broadcast.
BLOCK, BLOCKS, PART, STRETCH, SHARED, FEW = 16, 1 << 20, 1 << 10, 64, 1 << 20, 1 << 14
UNKNOWN = "unknown"


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the very ratio of the weights."""
    ratio = {s: Fraction(str(w)) for s, w in weights.items() if w > 0}
    if not ratio:
        return {}
    unit = lcm(*(x.denominator for x in ratio.values()))
    share = {s: int(x * unit) for s, x in ratio.items()}
    by = reduce(gcd, share.values())
    return {s: n // by for s, n in share.items()}


def _edf(blocks: dict[str, int], shares: dict[str, int], begin: int) -> dict[str, array]:
    """The slot, from `begin` on, of each block of each source, by earliest deadline.

    The flow has given a source share * v blocks at its time v, until they are used up. Sources are
    in the order of their ends; while the first p are used up, the flow is in slot gone[p] + left[p] * v.
    """
    names = sorted(shares, key=lambda s: (Fraction(blocks[s], shares[s]), s))
    n, w = [blocks[s] for s in names], [shares[s] for s in names]
    total = sum(w)
    gone, left = [0, *accumulate(n)], [total - x for x in (0, *accumulate(w))]
    ends = [a / b for a, b in zip(n, w, strict=True)]

    def edge(i: int, k: int) -> tuple[int, int]:
        """Floor and ceiling of the place in slots at which the flow has given source i its first k blocks."""
        p = min(bisect_left(ends, k / w[i]), i)
        while k * w[p] > n[p] * w[i]:
            p += 1
        while p and k * w[p - 1] < n[p - 1] * w[i]:
            p -= 1
        whole_, over = divmod(left[p] * k, w[i])
        return gone[p] + whole_, gone[p] + whole_ + (over > 0)

    slots = [array("q") for _ in names]
    released: dict[int, list[int]] = defaultdict(list)
    released[0] = list(range(len(names)))
    after = [edge(i, 1) for i in range(len(names))]  # where the flow ends the next block of each
    ready: list[tuple[int, int]] = []
    for t in range(gone[-1]):
        for i in released.pop(t, ()):
            heappush(ready, (after[i][1], i))
        _, i = heappop(ready)
        slots[i].append(begin + t)
        if (k := len(slots[i])) < n[i]:
            released[max(after[i][0], t + 1)].append(i)
            after[i] = edge(i, k + 1)
    return dict(zip(names, slots, strict=True))


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, array]:
    """The slot of each block of each source; the sources without weight come after the others."""
    blocks = {s: n for s, n in blocks.items() if n > 0}
    shares = whole({s: weights.get(s, 0) for s in blocks})
    first = _edf({s: blocks[s] for s in shares}, shares, 0)
    rest = {s: n for s, n in blocks.items() if s not in shares}
    return first | _edf(rest, dict.fromkeys(rest, 1), sum(blocks[s] for s in shares))


def mix(docs: DataFrame, weights: dict[str, float], block: int | None = None, source: str = "source", key: str = "doc_id") -> DataFrame:
    """All columns of `docs` and `mix_block`, `mix_slot` and `mix_row`: a row's block in its source, the block's slot and the row's place in it.

    Slots rise over the whole mix without gaps. The order of the mix is by slot and then row. Columns
    of `docs` called like these three are replaced.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_row")]
    # The rows' own columns travel in one, so none can clash with those of the plan.
    rows = docs.select(F.struct(*quoted(kept)).alias("_row"), F.coalesce(F.col(source).cast("string"), F.lit(UNKNOWN)).alias("_source"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("_key"))
    sizes = {r[0]: r[1] for r in rows.groupBy("_source").count().collect()}  # as the weights, a row a source
    many = max(1, -(-max(sizes.values(), default=0) // PART))
    block = block or max(BLOCK, -(-sum(sizes.values()) // BLOCKS))
    bits = F.conv(F.substring(F.md5(F.col("_key").cast("binary")), 1, 13), 16, 10).cast("long")
    rows = rows.withColumn("_hash", bits).withColumn("_part", F.floor(F.col("_hash") / 2**52 * many).cast("int"))
    parts = rows.groupBy("_source", "_part").agg(F.count("*").alias("_n"))
    begins = parts.withColumn("_begin", F.sum("_n").over(W.partitionBy("_source").orderBy("_part")) - F.col("_n")).drop("_n")
    if len(sizes) * many <= FEW:
        begins = F.broadcast(begins)  # `many` rows a source at most
    plan = schedule({s: -(-n // block) for s, n in sizes.items()}, weights)
    inside = F.row_number().over(W.partitionBy("_source", "_part").orderBy("_hash", "_key")) - 1
    placed = rows.withColumn("_inside", inside).join(begins, ["_source", "_part"]).withColumn("_at", F.col("_begin") + F.col("_inside"))
    placed = placed.withColumns({"mix_block": F.floor(F.col("_at") / block).cast("long"), "mix_row": (F.col("_at") % block).cast("int")})
    slots = _plan(spark, plan)
    if sum(map(len, plan.values())) <= SHARED:
        slots = F.broadcast(slots)
    out = placed.withColumn("_stretch", F.floor(F.col("mix_block") / STRETCH).cast("long")).join(slots, ["_source", "_stretch"])
    return out.select("_row.*", "mix_block", F.col("_slots")[(F.col("mix_block") % STRETCH).cast("int")].alias("mix_slot"), "mix_row")


def _plan(spark: SparkSession, plan: dict[str, array]) -> DataFrame:
    """The schedule, a row for each STRETCH blocks of a source."""
    sources, stretches, slots = [], [], []
    for s, at in plan.items():
        cuts = range(0, len(at), STRETCH)
        sources += [s] * len(cuts)
        stretches += range(len(cuts))
        slots += [np.frombuffer(at[c : c + STRETCH], np.int64) for c in cuts]
    columns = [pa.array(sources, pa.string()), pa.array(stretches, pa.int64()), pa.array(slots, pa.list_(pa.int64()))]
    return spark.createDataFrame(pa.table(columns, ["_source", "_stretch", "_slots"]), "_source string, _stretch long, _slots array<long>")


def tempered(docs: DataFrame, power: float = 0.5, source: str = "source") -> dict[str, int]:
    """Target weights by the rows of each source to a power, in whole thousandths: small sources get more than their share."""
    sizes = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit(UNKNOWN)).alias("s")).count().collect()
    return {r[0]: round(1000 * float(r[1]) ** power) for r in sizes}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, mix_block, mix_slot, mix_row for every document, at weights by the square root of the sources' sizes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, tempered(docs)).select("doc_id", "source", "mix_block", "mix_slot", "mix_row")


#: place(i, k) = sum over j of min(n_j, w_j k / w_i) is where the flow has given source i its first k blocks; then EDF, slot by slot.
OP4_SQL = """
WITH RECURSIVE rows_ AS (SELECT doc_id, source, coalesce(source, 'unknown') AS s, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT AS h FROM documents),
size AS (SELECT greatest(16, CAST(ceil(count(*) / 1048576) AS BIGINT)) AS block FROM documents),
placed AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY h, CAST(doc_id AS VARCHAR)) - 1 AS at FROM rows_),
sources AS (SELECT s, CAST(ceil(count(*) / any_value(block)) AS HUGEINT) AS n, CAST(round(1000 * sqrt(count(*))) AS HUGEINT) AS w FROM placed, size GROUP BY s),
named AS (SELECT *, row_number() OVER (ORDER BY n / w, s) AS i FROM sources),
marks AS (SELECT i, w, n, unnest(range(CAST(n AS BIGINT) + 1)) AS k FROM named),
place AS (SELECT m.i, m.k, m.n, any_value(m.w) AS w, sum(least(j.n * m.w, j.w * m.k)) AS x FROM marks m, named j GROUP BY 1, 2, 3),
edges AS (SELECT a.i, a.k, CAST(a.x // a.w AS BIGINT) AS release, CAST((b.x + b.w - 1) // b.w AS BIGINT) AS due FROM place a JOIN place b ON a.i = b.i AND b.k = a.k + 1),
f AS (
  SELECT CAST(0 AS BIGINT) AS t, i, CAST(0 AS BIGINT) AS had, FALSE AS went FROM named
  UNION ALL
  SELECT t + 1, i, had + CASE WHEN nth = 1 THEN 1 ELSE 0 END, nth = 1 FROM (
    SELECT f.t, f.i, f.had, row_number() OVER (ORDER BY CASE WHEN e.release <= f.t THEN 0 ELSE 1 END, e.due, f.i) AS nth
    FROM f LEFT JOIN edges e ON e.i = f.i AND e.k = f.had WHERE f.t < (SELECT sum(n) FROM named)))
SELECT p.doc_id, p.source, p.at // z.block AS mix_block, f.t - 1 AS mix_slot, CAST(p.at % z.block AS INTEGER) AS mix_row
FROM placed p, size z JOIN named n ON n.s = p.s JOIN f ON f.i = n.i AND f.went AND f.had - 1 = p.at // z.block
"""
