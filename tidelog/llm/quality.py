"""Quality classifier: histogram gradient-boosted trees over document statistics.

`fit` learns from labelled rows, at most `max_rows` of them (the bound of the sample; which rows
is decided by a hash of the id). `score` gives each document a score. Trees are complete binary
trees held in flat arrays, walked for a whole batch at once.

Defined results: a null or empty text has the statistics of an empty text and is scored like any
other, a text of any length as a whole; repeated rows each get their score; an id with several
labels counts with their rounded mean; null ids or labels teach nothing; of an id with several texts
all teach, and of all labelled texts at most `max_rows` do, by a hash; with no labelled row at all every score is 0.5;
an empty table gives no rows. Only `doc_id` and `text` are read, so other columns, whatever their
names, play no part; `good` carries them all, `score` all but one called like the score, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidelog.llm import textbuf
from tidelog.llm.tables import held_out, quoted, table

#: At most so many labelled rows are gathered on the driver for fitting.
MAX_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LAMBDA = 60, 4, 48, 0.2, 1.0

_CLASS = np.zeros(256, np.int64)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b".?", b",;:", b"!", b"|", b"#$%&*", b"@^~<>{}[]=+_/\\`", bytes(range(128, 192)), bytes(range(192, 256)))):
    _CLASS[list(_set)] = _i + 1
_CLASSES = 14


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text of a slice."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
    chars = np.maximum(size - counts[:, 12], 1)
    starts, ends, of = textbuf.words(data, offsets)
    n_words = np.bincount(of, minlength=n).astype(float)
    some = np.maximum(n_words, 1)
    length = (ends - starts).astype(float)
    per = lambda x: np.bincount(of, x, minlength=n) / some
    key = textbuf.hashes(textbuf.lowered(data), starts, ends)
    mark = (of.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24))
    distinct, times = np.unique(mark, return_counts=True)
    whose = (distinct >> np.uint64(40)).astype(np.int64)
    n_distinct = np.bincount(whose, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, whose, times)
    once = np.bincount(whose, times == 1, minlength=n)
    same = np.zeros(len(of))
    same[1:] = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
    kind = _CLASS[data]
    first, last = (kind[starts], kind[ends - 1]) if len(starts) else (np.zeros(0), np.zeros(0))
    pair = np.zeros(0, np.uint64)
    if len(of) > 1:
        with np.errstate(over="ignore"):
            two = textbuf.mix(key[:-1] * np.uint64(3) + key[1:])
        pair = np.unique(((of[:-1].astype(np.uint64) << np.uint64(40)) | (two >> np.uint64(24)))[of[1:] == of[:-1]])
    n_pairs = np.bincount((pair >> np.uint64(40)).astype(np.int64), minlength=n)
    mean = per(length)
    lines = counts[:, 5] + 1
    return np.column_stack([
        np.log1p(size), np.log1p(n_words), counts[:, 1:] / chars[:, None], counts[:, 2] / np.maximum(counts[:, 1] + counts[:, 2], 1),
        mean, np.sqrt(np.maximum(per(length * length) - mean * mean, 0)), n_distinct / some, most / some, once / some, per(same), n_pairs / some,
        per(length <= 3), per(length >= 14), per(first == 2), per((last == 6) | (last == 7)), per((last == 8) | (last == 9) | (last == 10)), n_words / lines, counts[:, 6] / some, n_distinct / np.sqrt(some),
    ]).astype(np.float32)


@dataclass
class Forest:
    """Complete trees of one depth: inner nodes level by level, then leaves."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray) -> Forest:
    """Gradient boosting for the logistic loss over binned features, level by level."""
    inner = 2**DEPTH - 1
    if not len(y):
        return Forest(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")).astype(np.float32) for f in range(width)]
    binned = np.column_stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)])  # bin > b  <=>  x > cuts[b]
    rate = np.clip(y.mean(), 0.02, 0.98)
    prior = float(np.log(rate / (1 - rate)))
    margin = np.full(n, prior)
    feature, threshold, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf, np.float32), np.zeros((TREES, inner + 1))
    flat = binned + np.arange(width) * BINS
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            level, here = 2**depth, 2**depth - 1
            where = ((node - here)[:, None] * (width * BINS) + flat).ravel()
            shape = (level, width, BINS)
            gs = np.bincount(where, np.repeat(g, width), minlength=level * width * BINS).reshape(shape).cumsum(2)
            hs = np.bincount(where, np.repeat(h, width), minlength=level * width * BINS).reshape(shape).cumsum(2)
            g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + LAMBDA) + (g_all - gs) ** 2 / (h_all - hs + LAMBDA) - g_all**2 / (h_all + LAMBDA)
            gain[(hs < 1) | (h_all - hs < 1)] = 0
            best = gain.reshape(level, -1).argmax(1)
            for k, b in enumerate(best):
                f, cut = divmod(int(b), BINS)
                if gain[k, f, cut] > 1e-6 and cut < len(cuts[f]):
                    feature[t, here + k], threshold[t, here + k] = f, cuts[f][cut]
            node = 2 * node + 1 + (x[np.arange(n), feature[t][node]] > threshold[t][node])
        ends = node - inner
        leaf[t] = -RATE * np.bincount(ends, g, minlength=inner + 1) / (np.bincount(ends, h, minlength=inner + 1) + LAMBDA)
        margin += leaf[t][ends]
    return Forest(prior, feature, threshold, leaf)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = textbuf.texts(batch)
        for a, b in textbuf.slices(col):
            x = features(*textbuf.view(col, a, b))
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Forest:
    """Learn from labelled rows that are not held out, at most `max_rows` of them."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("y")).select("doc_id", (F.col("y") >= 0.5).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "y", "text")  # max_rows ids at most
    made = rows.mapInArrow(_feature_rows, "doc_id long, y int, x binary")
    got = made.orderBy(F.xxhash64("doc_id", "x"), "doc_id", "x").limit(max_rows).toArrow()  # an id may have any number of rows
    if not got.num_rows:
        return boost(np.zeros((0, 1)), np.zeros(0))
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(got.num_rows, -1)
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort([*x.T[:3], got.column("doc_id").to_numpy()])
    return boost(x[order], y[order])


def _scored(batch: pa.RecordBatch, text: str, forest: Forest) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for part, col in textbuf.pieces(batch, text):
        yield part, forest.score(features(*textbuf.view(col, 0, len(col))))


def score(spark: SparkSession, docs: DataFrame, forest: Forest, column: str = "score") -> DataFrame:
    """All columns of `docs` (any of them called `column` is replaced) and the score of `text`."""
    kept = [c for c in docs.columns if c != column]
    names, text = [f"c{i}" for i in range(len(kept))], f"c{kept.index('text')}"  # by place, so that any name will do
    shared = spark.sparkContext.broadcast(forest)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, got in _scored(batch, text, shared.value):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got)], [*names, "score"])

    plain = docs.select(*quoted(kept)).toDF(*names)
    return plain.mapInArrow(scored, StructType([*plain.schema.fields, StructField("score", DoubleType())])).toDF(*kept, column)


def good(spark: SparkSession, docs: DataFrame, forest: Forest, least: float) -> DataFrame:
    """The rows of `docs` whose text scores `least` or more."""
    names, text = [f"c{i}" for i in range(len(docs.columns))], f"c{docs.columns.index('text')}"
    shared = spark.sparkContext.broadcast(forest)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, got in _scored(batch, text, shared.value):
                yield part.filter(pa.array(got >= least))

    plain = docs.toDF(*names)
    return plain.mapInArrow(kept, plain.schema).toDF(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = fit(docs, table(spark, sf_dir, "labels"))
    got = score(spark, docs, forest)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
