"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Before each step every partition keeps of its edges only what connects the same vertices, and what is
left goes to as many partitions as it needs, as long as that halves them. Edges that come down to one
partition so are settled without a step, and the driver need not schedule the many tasks of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.tables import settle

#: Rows of a partition of what is written between steps.
ROWS = 200_000


class Forest:
    """Edges of a task, kept as one to the least vertex that a vertex is connected with."""

    def __init__(self) -> None:
        self.to: dict = {}

    def least(self, v):
        path, to = [], self.to
        while (up := to.setdefault(v, v)) != v:
            path.append(v)
            v = up
        for x in path:
            to[x] = v
        return v

    def add(self, a, b) -> None:
        a, b = self.least(a), self.least(b)
        if a != b:
            self.to[max(a, b)] = min(a, b)

    def edges(self, kind: pa.DataType) -> pa.RecordBatch:
        """(a, b): each vertex with the least one, that one itself left out; the forest is empty then."""
        found = [(v, self.least(v)) for v in list(self.to)]
        found = [e for e in found if e[0] != e[1]]
        self.to = {}
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], kind), pa.array([b for _, b in found], kind)], ["a", "b"])


def _written(frame: DataFrame) -> tuple[DataFrame, int]:
    """The rows, written, in partitions of about ROWS, and how many these are: few edges need few tasks, whatever the shuffles use."""
    out = settle(frame)
    parts = max(1, ceil(out.count() / ROWS))
    return out.coalesce(parts), parts


def _connected(edges: DataFrame) -> DataFrame:
    """What connects the same vertices as the edges of each partition do; of one partition, the components."""
    most = 2 * ROWS  # the ends of ROWS edges at most: a task whose partition is larger gives back what it has and begins anew

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kind = Forest(), None
        for batch in batches:
            kind = batch.column(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.add(a, b)
            if len(forest.to) > most:
                yield forest.edges(kind)
        if kind is not None:
            yield forest.edges(kind)

    return edges.mapInArrow(run, edges.schema)


def _large(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a vertex is linked to the least of the vertex and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written first: Spark splits a hot vertex in the join only if no aggregate stands between it and the exchange.
    least = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = settle(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex has one neighbour below it, or is one and has none: then stars and components are the same."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).count() == 0


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(a, b): each vertex of an edge with the least vertex of its component, that one itself left out.

    `edges` has columns a and b of one ordered type; loops and repeated edges do no harm.
    """
    now, parts = _written(edges.where(F.col("a") != F.col("b")).select("a", "b"))
    for _ in range(most):
        if parts == 1:
            return settle(_connected(now))
        now, left = _written(_connected(now))
        if 2 * left > parts:  # partitions alone don't get on
            if _stars(now):
                return now
            now, left = _written(_small(_written(_large(now))[0]).where(F.col("a") != F.col("b")).distinct())
        parts = left
    raise RuntimeError(f"components have not settled after {most} rounds")
