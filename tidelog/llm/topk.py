"""Exact top-k search by inner product: a ball tree in each shard, branch and bound over it.

A sample of the rows (SAMPLE at most) gives the centres of cells, CELLS at most; every row goes to its
nearest centre, and a cell of more than SHARD rows is dealt to parts by a hash. A shard is a part of
a cell. Each cell's ball holds all its rows, so a query's scores in a cell can't exceed q.c + |q| r;
the balls are CELLS rows at most and known everywhere.

A query starts with the kth score that it has in the sample and visits the cells in WAVES: first its
best cell by that bound, then the next few, then the rest, and always only those whose bound reaches
the kth score that it has found anywhere by then. So a wave's result is shared with all cells of the
next one. Inside a shard the same rule holds for the balls of its tree: each query goes into the
child of the higher bound first and leaves a branch once its kth score so far is above its bound.

Components become floor(256 x) in double arithmetic, which are whole numbers; scores are their exact
inner products, in doubles where these hold them, in 64-bit numbers or Python's own where not.

Defined results: vectors that are null or hold a null, NaN or infinite component (or one whose 256-fold
is none of a double's) take no part, as queries or candidates, nor do rows with a null id; shorter
vectors count as if zeros followed; an empty vector scores 0 with all; a query's own rows are those
with its id; rows repeated in full count each as candidates, once as queries; equal scores go by the
smaller id; ranks go by the exact score, and one beyond 64 bits is given as the nearest that fits. An
empty table gives no rows. Columns besides the id and the vector are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.tables import settle, table

#: Rows of the sample and cells, at most; least rows of a cell on average, most rows of a shard, of a leaf; queries that meet a shard at once, and that a tree is walked for at once; cells that a query has visited after each wave but the last.
K, SAMPLE, CELLS, CELL, SHARD, LEAF, GROUP, BLOCK, WAVES = 5, 4096, 1024, 256, 2048, 64, 4096, 512, (1, 16)
_LOW, _HIGH = -(2**63), 2**63 - 1


def quantised(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v, the whole-number components as little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(over="ignore"):
                whole = np.floor(256 * col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64))
            bad = np.append(0, np.cumsum(~np.isfinite(whole)))
            ends = np.cumsum(size)
            raw = (whole + 0.0).astype("<f8").tobytes()
            ok = (bad[ends] == bad[ends - size]) & col.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
            pick = np.flatnonzero(ok)
            a, b = (8 * (ends - size)[pick]).tolist(), (8 * ends[pick]).tolist()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(pick)), pa.array([raw[i:j] for i, j in zip(a, b, strict=True)], pa.binary())], ["vec_id", "v"])

    return vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, v binary")


def matrix(cells: list[bytes], width: int = 0) -> np.ndarray:
    """Rows of components, zeros after the shorter ones."""
    width = max([width, *(len(c) // 8 for c in cells)])
    return np.frombuffer(b"".join(c.ljust(8 * width, b"\0") for c in cells), "<f8").reshape(len(cells), width)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: int64, or Python's numbers where that might be too small."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if most < 2**52:
        return (q @ x.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return whole(q).astype(object) @ whole(x).astype(object).T


class Tree:
    """Balls over the rows of a matrix; nodes are (centre, radius, first, last, left, right). Of equal rows only as many are kept as can be in an answer."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int = K, leaf: int = LEAF) -> None:
        order = np.lexsort((ids,))
        x, ids = x[order], ids[order]
        if len(x):
            keep = _enough(x, ids, k)
            x, ids = x[keep], ids[keep]
        self.k, self.leaf = k, leaf
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []
        self.order = np.arange(len(x))
        if len(x):
            self._build(x, 0, len(x))
        self.x, self.ids = x[self.order], ids[self.order]
        self.longest = float(np.sqrt((self.x**2).sum(1)).max(initial=0))

    def _build(self, every: np.ndarray, a: int, b: int) -> int:
        here = self.order[a:b]
        x = every[here]
        centre, far, cut = split(x, b - a > self.leaf)
        at = len(self.nodes)
        self.nodes.append((centre, far, a, b, -1, -1))
        if cut is not None:
            side = x @ cut[0] > cut[1]
            self.order[a:b] = np.concatenate([here[~side], here[side]])
            middle = b - int(side.sum())
            left = self._build(every, a, middle)
            self.nodes[at] = (centre, far, a, b, left, self._build(every, middle, b))
        return at

    def search(self, queries: np.ndarray, own: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, score and id of the best k rows of each query that may reach its `low`."""
        self.q, self.own = queries, own
        self.length = np.sqrt((queries**2).sum(1))
        self.slack = 1e-9 * self.length * self.longest + 1e-6
        self.low = low.astype(float)
        self.scores: list[list[int]] = [[] for _ in own]
        self.best: list[list[int]] = [[] for _ in own]
        if self.nodes:
            every = np.arange(len(own))
            self._visit(0, every, self._bound(0, every))
        place = np.repeat(np.arange(len(own)), [len(s) for s in self.scores])
        scores = [s for row in self.scores for s in row]
        return place, np.array(scores, object if any(not _LOW < s < _HIGH for s in scores) else np.int64), np.array([i for row in self.best for i in row], np.int64)

    def _bound(self, node: int, active: np.ndarray) -> np.ndarray:
        centre, radius = self.nodes[node][:2]
        return self.q[active] @ centre + self.length[active] * radius + self.slack[active]

    def _visit(self, node: int, active: np.ndarray, bound: np.ndarray) -> None:
        active = active[bound >= self.low[active]]
        if not len(active):
            return
        _, _, a, b, left, right = self.nodes[node]
        if left < 0:
            for i in range(a, b, self.leaf):
                self._leaf(i, min(b, i + self.leaf), active)
            return
        bounds = self._bound(left, active), self._bound(right, active)
        first = bounds[0] >= bounds[1]  # each query goes into its better child first
        for child, of, those in ((left, 0, first), (right, 1, ~first), (right, 1, first), (left, 0, ~first)):
            if those.any():
                self._visit(child, active[those], bounds[of][those])

    def _leaf(self, a: int, b: int, active: np.ndarray) -> None:
        ids = self.ids[a:b]
        score = products(self.q[active], self.x[a:b])
        other = ids[None, :] != self.own[active][:, None]
        near = other & (score >= self.low[active][:, None] - self.slack[active][:, None])
        for r in np.flatnonzero(near.any(1)).tolist():
            i, cols = int(active[r]), near[r]
            both = sorted(zip([-s for s in self.scores[i]] + [-s for s in score[r, cols].tolist()], self.best[i] + ids[cols].tolist(), strict=True))[: self.k]
            self.scores[i], self.best[i] = [-s for s, _ in both], [x for _, x in both]
            if len(both) == self.k:
                self.low[i] = max(self.low[i], float(self.scores[i][-1]) - self.slack[i])


def _enough(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that an answer may need: of equal rows, k + 1 ids (one may be the query's own), k times each; ids must rise."""
    _, same = np.unique(x, axis=0, return_inverse=True)
    same = same.ravel()
    order = np.argsort(same, kind="stable")  # by vector, then id
    s, i = same[order], ids[order]
    new = np.append(True, s[1:] != s[:-1])
    fresh = new | np.append(True, i[1:] != i[:-1])
    at = np.arange(len(s))
    nth = np.cumsum(fresh) - np.maximum.accumulate(np.where(new, np.cumsum(fresh), 0))
    again = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return np.sort(order[(nth <= k) & (again < k)])


def split(x: np.ndarray, wanted: bool) -> tuple[np.ndarray, float, tuple[np.ndarray, float] | None]:
    """Centre and radius of the rows, and a direction and the place on it that cuts them in two, if they differ.

    The cut is half way between two rows far from each other, which seldom goes through a cluster; but if that leaves
    a side with less than a tenth, it is the median.
    """
    centre = x.mean(0)
    far = np.sqrt(((x - centre) ** 2).sum(1))
    radius = float(far.max()) * (1 + 1e-9) + 1e-6
    if not wanted or far.max() <= 0:
        return centre, radius, None
    one = x[far.argmax()]
    two = x[((x - one) ** 2).sum(1).argmax()]
    to = (two - one) / max(float(np.abs(two - one).max()), 1e-300)
    at = x @ to
    cut = float((one @ to + two @ to) / 2)
    if not 0.1 <= (at > cut).mean() <= 0.9:
        cut = float(np.median(at))
    if not (at > cut).any():
        below = at[at < cut]
        if not len(below):
            return centre, radius, None
        cut = float(below.max())
    return centre, radius, (to, cut)


class Cells:
    """Centres chosen from the sample, each far from those before it, then moved to the mean of the rows that are nearest to it."""

    def __init__(self, x: np.ndarray, most: int) -> None:
        self.width = x.shape[1] if x.ndim == 2 else 0
        if not len(x):
            self.centres = np.zeros((1, self.width))
            return
        gap, picked = ((x - x.mean(0)) ** 2).sum(1), []
        at = int(gap.argmin())  # the first is the one in the middle
        gap = np.full(len(x), np.inf)
        while len(picked) < most and gap[at] > 0:
            picked.append(at)
            gap = np.minimum(gap, ((x - x[at]) ** 2).sum(1))
            at = int(gap.argmax())
        self.centres = x[picked]
        cell = self.place(x)
        self.centres = np.array([x[cell == c].mean(0) if (cell == c).any() else self.centres[c] for c in range(len(picked))])

    def place(self, x: np.ndarray) -> np.ndarray:
        """The nearest centre of each row; components beyond the sample's width don't decide."""
        x = x[:, : self.width] if x.shape[1] >= self.width else np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        return ((self.centres**2).sum(1) - 2 * (x @ self.centres.T)).argmin(1)

    def distance(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How far each row is from its cell's centre."""
        centre = np.pad(self.centres, ((0, 0), (0, max(0, x.shape[1] - self.width))))[cell]
        return np.sqrt(((np.pad(x, ((0, 0), (0, max(0, self.width - x.shape[1])))) - centre) ** 2).sum(1))


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray]]:
    cells = batch.column(column).to_pylist()
    for a in range(0, len(cells), BLOCK):
        yield a, min(len(cells), a + BLOCK), matrix(cells[a : a + BLOCK])


def search(spark: SparkSession, vectors: DataFrame, every: int = 50, k: int = K, seen: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query (ids divisible by `every`).

    `seen`, if given, gets (pairs of a query and a cell that were visited, all such pairs) of each wave.
    """
    clean = quantised(vectors)
    sample = clean.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(SAMPLE).collect()  # SAMPLE rows at most
    cells_of = lambda n: max(1, min(CELLS, len(sample), n // CELL))
    tree = Cells(matrix([bytes(r[1]) for r in sample]), cells_of(vectors.count()))
    shared = spark.sparkContext.broadcast((tree, np.array([r[0] for r in sample], np.int64), [bytes(r[1]) for r in sample]))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value[0]
        for batch in batches:
            for a, b, x in _blocks(batch, 1):
                cell = at.place(x)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(at.distance(x, cell)), pa.array(np.sqrt((x**2).sum(1)))], ["vec_id", "v", "salt", "cell", "far", "length"])

    # Rows repeated in full must not meet in one shard: the salt tells them apart by where they were read.
    rows = settle(clean.withColumn("salt", F.monotonically_increasing_id()).mapInArrow(route, "vec_id long, v binary, salt long, cell int, far double, length double"))
    balls = rows.groupBy("cell").agg(F.max("far").alias("radius"), F.max("length").alias("length"), F.count("*").alias("n")).collect()  # CELLS rows at most
    if not balls:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    radius, parts = np.full(len(tree.centres), -np.inf), np.ones(len(tree.centres), np.int64)
    for r in balls:
        radius[r["cell"]], parts[r["cell"]] = r["radius"] * (1 + 1e-9) + 1e-6, -(-r["n"] // SHARD)
    longest = max(r["length"] for r in balls)
    known = spark.sparkContext.broadcast((radius, longest))

    def ranked(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query its cells by falling bound, and the bounds; cells without rows have none."""
        at, (radius, longest) = shared.value[0], known.value
        centres = at.centres
        width = max(q.shape[1], centres.shape[1])
        q, centres = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, centres))
        length = np.sqrt((q**2).sum(1))[:, None]
        with np.errstate(invalid="ignore"):
            bound = np.where(np.isfinite(radius), q @ centres.T + length * np.where(np.isfinite(radius), radius, 0) + 1e-9 * length * longest + 1e-6, -np.inf)
        order = np.argsort(-bound, axis=1, kind="stable")
        return order, np.take_along_axis(bound, order, 1)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The kth score of each query in the sample."""
        _, ids, cells = shared.value
        for batch in batches:
            for a, b, q in _blocks(batch, 1):
                x = matrix(cells, q.shape[1])
                at = Tree(x, ids, k, len(x))
                own = batch.column(0).to_numpy()[a:b]
                place, score, _ = at.search(np.pad(q, ((0, 0), (0, x.shape[1] - q.shape[1]))), own, np.full(b - a, -np.inf))
                low = np.full(b - a, -np.inf)
                found = np.bincount(place, minlength=b - a)
                last = np.cumsum(found) - 1
                full = found >= k
                low[full] = np.nextafter(score[last[full]].astype(float), -np.inf)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(low)], ["vec_id", "v", "low"])

    def visits(first: int, last: int | None):
        """(cell, vec_id, v, low) for the cells that a query visits in a wave."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, _, q in _blocks(batch, 1):
                    order, bound = ranked(q)
                    order, bound = order[:, first:last], bound[:, first:last]
                    low = batch.column(2).to_numpy()[a : a + len(q)]
                    r, c = np.nonzero((bound >= low[:, None]) & (bound > -np.inf))
                    for i in range(0, len(r), 8 * BLOCK):
                        some = pa.array(a + r[i : i + 8 * BLOCK])
                        yield pa.RecordBatch.from_arrays([pa.array(order[r, c][i : i + 8 * BLOCK], pa.int32()), *(x.take(some) for x in batch.columns)], ["cell", "vec_id", "v", "low"])

        return run

    def room(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if left.num_rows and right.num_rows:
            cells, mine = left.column("v").to_pylist(), right.column("v").to_pylist()
            width = max(len(c) // 8 for c in (*cells, *mine))
            at = Tree(matrix(cells, width), left.column("vec_id").to_numpy(), k)
            own, low = right.column("vec_id").to_numpy(), right.column("low").to_numpy()
            for i in range(0, len(mine), BLOCK):
                place, score, best = at.search(matrix(mine[i : i + BLOCK], width), own[i : i + BLOCK], low[i : i + BLOCK])
                exact = [None if _LOW < s < _HIGH else int(s).to_bytes(-(-int(s).bit_length() // 8) + 1, "big", signed=True) for s in score] if score.dtype == object else [None] * len(score)
                capped = [min(max(int(s), _LOW), _HIGH) for s in score] if score.dtype == object else score
                out.append(pa.table({"query_id": own[i + place], "v": pa.array([mine[i + j] for j in place.tolist()], pa.binary()), "vec_id": best, "score": pa.array(capped, pa.int64()), "exact": pa.array(exact, pa.binary())}))
        return pa.concat_tables(out) if out else pa.schema([("query_id", pa.int64()), ("v", pa.binary()), ("vec_id", pa.int64()), ("score", pa.int64()), ("exact", pa.binary())]).empty_table()

    found_ddl = "query_id long, v binary, vec_id long, score long, exact binary"
    of_cell = lambda numbers: F.array(*(F.lit(int(x)) for x in numbers))[F.col("cell")]
    size = of_cell(parts)

    def wave(queries: DataFrame, first: int, last: int | None) -> DataFrame:
        asked = settle(queries.mapInArrow(visits(first, last), "cell int, vec_id long, v binary, low double"))
        count = {r[0]: r[1] for r in asked.groupBy("cell").count().collect()}  # CELLS rows at most
        if seen is not None:
            seen.append((sum(count.values()), queries.count() * len(balls)))
        if not count:
            return spark.createDataFrame([], found_ddl)
        # A cell's queries meet each of its parts in groups; cells that no query visits are not moved.
        groups = of_cell(-(-count.get(c, 0) // GROUP) for c in range(len(parts)))
        left = rows.where(groups > 0).select("cell", F.pmod(F.xxhash64("salt", F.lit(3)), size).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), groups - 1)).alias("group"), "vec_id", "v")
        right = asked.select("cell", F.explode(F.sequence(F.lit(0), size - 1)).alias("part"), F.pmod(F.xxhash64("vec_id", "v"), groups).cast("int").alias("group"), "vec_id", "v", "low")
        by = ["cell", "part", "group"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(room, found_ddl)

    def best(found: DataFrame) -> DataFrame:
        # Scores that fit are ordered as such; where one of a query's doesn't, its exact bytes decide between equal capped ones.
        order = [F.desc("score"), *_exact_order(), "vec_id"]
        nth = F.row_number().over(W.partitionBy("query_id", "v").orderBy(*order))
        return found.withColumn("rank", nth).where(F.col("rank") <= k)

    queries = settle(clean.where(F.col("vec_id") % every == 0).distinct().mapInArrow(start, "vec_id long, v binary, low double"))
    steps = [0, *(w for w in WAVES if w < len(balls)), None] if len(balls) > WAVES[0] else [0, None]
    found: DataFrame | None = None
    for first, last in zip(steps, steps[1:], strict=False):
        new = wave(queries, first, last)
        found = new if found is None else found.select(*new.columns).union(new)
        if last is None:
            break
        found = settle(best(found))
        kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "v", F.col("score").cast("double").alias("kth"))
        # Scores near the ends of a long are rounded down, so that nothing equal is left out.
        kth = kth.withColumn("kth", F.col("kth") - F.abs("kth") * F.lit(2.0**-52))
        queries = settle(queries.join(kth, ["vec_id", "v"], "left").select("vec_id", "v", F.greatest("low", F.coalesce("kth", "low")).alias("low")))
    return best(found).select("query_id", "rank", "vec_id", "score")


def _exact_order() -> list:
    """Order of whole numbers written as signed big-endian bytes: by sign and length, then the bytes."""
    negative = F.substring(F.hex("exact"), 1, 1) >= "8"
    length = F.octet_length("exact")
    return [F.desc(F.when(negative, -length).otherwise(length)), F.desc("exact")]


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: five rows for each vector whose id is divisible by 50."""
    return search(spark, table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH c AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
      FROM c AS q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
