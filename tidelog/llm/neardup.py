"""Near-duplicates by a chosen-path set similarity join.

A document's set is its distinct word shingles. Documents with equal sets are one vertex from the
start. Each vertex has PLACES minwise tokens; at the root of each of TREES independent trees it
branches by BRANCHES of them, so two vertices of similarity J part in all roots with probability
(1 - J) ** (TREES * BRANCHES): 3e-7 at J = 0.85. A node that holds one vertex ends; a node of at most
NODE vertices is compared exhaustively by the sketches of its vertices; a larger one branches again
by BRANCHES further tokens that its path chooses, DEPTH times at most, and what is larger even then
is compared exhaustively all the same, so no vertex is left out whatever a node's size. One task
compares ALONE vertices at most; a node of more is compared in rooms.

Vertices whose sketches agree well enough form families (components). Each family's texts are
brought together once and compared in full, in rooms of about ROOM shingles. Links are confirmed on
the full sets, and their components are the result.

Where a node or a family has more than one room, each block of it first meets itself and a few
representatives of the whole. That connects near copies of one text, however many there are. Only
those that are then not connected with the greater part of it meet every other row, in wide blocks;
this is exact: a pair that isn't compared is of two that are connected already.

Defined results: a null text or one without words has the empty set, is linked with nothing and is
its own component; a text of fewer words than a shingle has one shingle, its words; texts of any
length are read whole; repeated rows are equal sets; rows with a null id take part, and a component of
such rows alone has a null id; a row is kept if its id is its component's; an empty table gives no
rows. `near_duplicates` reads doc_id and text alone; `deduplicated` carries columns of any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import textbuf
from tidelog.llm.components import Forest, components
from tidelog.llm.tables import quoted, settle, table

TREES, BRANCHES, PLACES, NODE, DEPTH, ROOM = 4, 2, 128, 4096, 3, 1 << 17
#: Vertices of a node that one task compares; half as many are a block of a larger node.
ALONE = 1024
#: Representatives of a node or family that has several rooms; vertices of which a task remembers to what they are connected.
FEW, HELD = 4, 1 << 17
#: Blocks that make a wide one, which what is left over meets; tasks that the rows of a group are dealt to in a join.
WIDE, SALT = 8, 16
#: Standard deviations below the threshold down to which sketches count as alike; bits of the filter of texts.
SIGMAS, FILTER = 4.2, 1 << 24

_U = np.uint64
_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, PLACES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, PLACES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of the texts of a slice in order, and where each text's begin (one more at the end)."""
    a, b, row = textbuf.words(data, off)
    key = textbuf.hashes(textbuf.lowered(data), a, b)
    n = len(off) - 1
    count = np.bincount(row, minlength=n)
    first = np.cumsum(np.append(0, count))
    total = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.cumsum(np.append(0, total))
    out = np.zeros(int(begin[-1]), _U)

    def joined(at: np.ndarray, words: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            acc = key[at] + _U(words)
            for i in range(1, words):
                acc = textbuf.mix(acc * _U(0x9E3779B97F4A7C15) + key[at + i])
        return textbuf.mix(acc)

    for words in range(1, width):
        short = np.flatnonzero(count == words)
        out[begin[short]] = joined(first[short], words)
    long = np.flatnonzero(count >= width)
    if len(long):
        inside = np.arange(int(total[long].sum())) - np.repeat(np.cumsum(total[long]) - total[long], total[long])
        out[np.repeat(begin[long], total[long]) + inside] = joined(np.repeat(first[long], total[long]) + inside, width)
    return out, begin


def minwise(keys: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The least permuted hash of each non-empty text at each place."""
    low = (keys >> _U(32)).astype(np.uint32)
    out = np.zeros((len(begin), PLACES), np.uint32)
    for i in range(PLACES):
        out[:, i] = np.minimum.reduceat((low ^ _XOR[i]) * _MUL[i], begin)
    return out


def _tokens(least: np.ndarray) -> np.ndarray:
    """One byte for each place."""
    return (textbuf.mix(least.astype(_U)) >> _U(56)).astype(np.uint8)


def vertices(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n and, for non-empty sets, vid, sketch and roots of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = TREES * BRANCHES
        for batch in batches:
            col = textbuf.texts(batch)
            for a, b in textbuf.slices(col):
                keys, begin = shingles(*textbuf.view(col, a, b), width)
                some = np.flatnonzero(np.diff(begin))
                sets = [np.unique(keys[begin[i] : begin[i + 1]]) for i in some]
                n = np.zeros(b - a, np.int64)
                n[some] = [len(s) for s in sets]
                vid, sketch, root = [None] * (b - a), [None] * (b - a), [None] * (b - a)
                if len(some):
                    least = minwise(keys, begin[some])
                    tokens = _tokens(least)
                    with np.errstate(over="ignore"):
                        nodes = textbuf.mix((least[:, :roots].astype(_U) << _U(8)) + np.arange(roots, dtype=_U)).view(np.int64)
                    for j, i in enumerate(some):
                        vid[i] = hashlib.blake2b(sets[j].tobytes(), digest_size=16).digest()
                        sketch[i], root[i] = tokens[j].tobytes(), nodes[j]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(n), pa.array(vid, pa.binary()), pa.array(sketch, pa.binary()), pa.array(root, pa.list_(pa.int64()))], ["doc_id", "text_key", "n", "vid", "sketch", "roots"])

    return _keyed(docs).mapInArrow(run, "doc_id long, text_key long, n long, vid binary, sketch binary, roots array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))


def _branched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The children of nodes: each path chooses BRANCHES places by its hash."""
    for batch in batches:
        node = batch.column(0).to_numpy().view(_U)
        if not len(node):
            continue
        tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(node), PLACES)
        for i in range(BRANCHES):
            with np.errstate(over="ignore"):
                place = (textbuf.mix(node + _U(i + 1)) % _U(PLACES)).astype(np.int64)
                child = textbuf.mix(textbuf.mix(node + _U(i + 1)) + tokens[np.arange(len(node)), place])
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1), batch.column(2)], ["node", "vid", "sketch"])


Row = tuple[bytes, bool | None, bytes | None, Any]  # vid, mine, label, value


def _rooms_of(batches: Iterator[pa.RecordBatch], values: Callable[[pa.RecordBatch], Iterator[Any]]) -> Iterator[list[Row]]:
    """The rows of each room: batches are (group, i, j, vid, mine, label, and what `values` makes of it), sorted by the first three."""
    held: list[Row] = []
    now = None
    for batch in batches:
        keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        for key, vid, mine, label, value in zip(keys, *(batch.column(i).to_pylist() for i in range(3, 6)), values(batch), strict=True):
            if key != now and held:
                yield held
                held = []
            now = key
            held.append((vid, mine, label, value))
    if held:
        yield held


def _connecting(values: Callable, within: Callable[[list[Row]], Iterator[tuple[bytes, bytes]]], across: Callable[[list[Row]], Iterator[tuple[bytes, bytes]]]):
    """A task's edges: `within` connects the rows of a room, `across` those that are `mine` with rows of other labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for room in _rooms_of(batches, values):
            if len(room) > 1:
                for a, b in within(room) if room[0][1] is None else across(room):
                    forest.add(a, b)
            if len(forest.to) > HELD:
                yield forest.edges(pa.binary())
        yield forest.edges(pa.binary())

    return run


def _alike(least: float):
    """Edges between vertices whose sketches agree in `least` of the places."""

    def matrix(room: list[Row]) -> np.ndarray:
        return np.frombuffer(b"".join(r[3] for r in room), np.uint8).reshape(len(room), PLACES)

    def within(room: list[Row]) -> Iterator[tuple[bytes, bytes]]:
        x = matrix(room)
        left, queue = np.arange(1, len(room)), [0]
        while len(left):
            if not queue:
                queue, left = [int(left[0])], left[1:]
                continue
            i = queue.pop()
            near = (x[left] == x[i]).sum(1) >= least * PLACES
            for j in left[near].tolist():
                yield room[i][0], room[j][0]
            queue += left[near].tolist()
            left = left[~near]

    def across(room: list[Row]) -> Iterator[tuple[bytes, bytes]]:
        x = matrix(room)
        for i, (vid, mine, label, _) in enumerate(room):
            if mine:
                for j in np.flatnonzero((x == x[i]).sum(1) >= least * PLACES).tolist():
                    if room[j][2] != label:
                        yield vid, room[j][0]

    return _connecting(lambda batch: iter(batch.column(6).to_pylist()), within, across)


def _salted(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` (group, vid, ...) joined with a table of one row a group, so that a large group's rows are no single task's."""
    few = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("vid", F.lit(3)), F.lit(SALT)).cast("int")).join(few, ["group", "_salt"], how).drop("_salt")


def _in_rooms(rows: DataFrame, some_large: bool, limit: int, connect, payload: str) -> DataFrame:
    """(a, b): the components of what `connect` finds connected in each group of `rows` (group, vid, n, blocks and `payload`)."""
    rows = rows.withColumns({"mine": F.lit(None).cast("boolean"), "label": F.lit(None).cast("binary")})
    shown = ["group", "i", "j", "vid", "mine", "label", payload]
    own = F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")
    zero = F.lit(0).cast("int")

    def met(each: DataFrame) -> DataFrame:
        return each.select(*shown).repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(connect, "a binary, b binary")

    first = rows.where("blocks = 1").withColumns({"i": zero, "j": zero})
    if not some_large:
        return components(met(first))
    large = settle(rows.where("blocks > 1"))
    # A block meets itself and the representatives.
    part = F.pmod(F.xxhash64("vid", F.lit(5)), F.lit(FEW))
    some = settle(large.groupBy("group", part).agg(F.min("vid").alias("vid")).select("group", "vid", F.lit(True).alias("some")))
    every = F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))
    second = large.join(some, ["group", "vid"], "left").withColumn("i", F.explode(F.when(F.col("some"), every).otherwise(F.array(own)))).withColumn("j", zero)
    found = components(met(first.select(*shown).union(second.select(*shown))))
    label = found.select(F.col("a").alias("vid"), F.col("b").alias("label"))
    labels = settle(large.select("group", "vid", "n").join(label, "vid", "left").withColumn("label", F.coalesce("label", "vid")))
    sizes = labels.groupBy("group", "label").agg(F.count("*").alias("size"))
    greatest = settle(sizes.groupBy("group").agg(F.max_by("label", F.struct("size", "label")).alias("greatest")))
    rest = settle(_salted(labels, greatest).where(F.col("label") != F.col("greatest")).select("group", "vid", "n"))
    if rest.isEmpty():
        return found
    # What isn't in the greater part meets all: it is cut in parts that a task can hold, and the whole in wide blocks.
    parts = settle(rest.groupBy("group").agg(F.ceil(F.sum("n") / (WIDE * limit)).alias("parts")))
    known = _salted(large.drop("label").join(labels.select("group", "vid", "label"), ["group", "vid"]), parts).withColumn("wide", F.ceil(F.col("blocks") / WIDE))
    cut, block = F.pmod(F.xxhash64("vid", F.lit(9)), F.col("parts")).cast("int"), F.pmod(F.xxhash64("vid"), F.col("wide")).cast("int")
    upto = lambda c: F.sequence(F.lit(0), (F.col(c) - 1).cast("int"))
    mine = known.join(rest.select("group", "vid"), ["group", "vid"], "left_semi").withColumns({"mine": F.lit(True), "i": cut, "j": F.explode(upto("wide"))})
    whole = known.withColumns({"mine": F.lit(False), "j": block, "i": F.explode(upto("parts"))})
    return components(found.union(met(mine.select(*shown).union(whole.select(*shown)))))


def _families(points: DataFrame, least: float) -> DataFrame:
    """(a, b): vertices with the least vertex of their family; single ones and the least are left out."""
    sketches = points.select("vid", "sketch")
    paths = points.select(F.explode("roots").alias("node"), "vid")

    def counted(rows: DataFrame) -> DataFrame:
        # Counts are written first: Spark splits a hot node in the join only if no aggregate stands before it.
        return rows.join(settle(rows.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > 1)), "node")

    nodes = settle(counted(paths).join(sketches, "vid").select("node", "vid", "sketch", "size"))
    found = [nodes.where(F.col("size") <= NODE)]
    for _ in range(DEPTH):
        large = nodes.where(F.col("size") > NODE)
        if large.isEmpty():
            break
        nodes = settle(counted(settle(large.select("node", "vid", "sketch").mapInArrow(_branched, "node long, vid binary, sketch binary"))).select("node", "vid", "sketch", "size"))
        found.append(nodes.where(F.col("size") <= NODE))
    else:
        found.append(nodes.where(F.col("size") > NODE))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    blocks = F.when(F.col("size") <= ALONE, F.lit(1)).otherwise(F.ceil(F.col("size") / (ALONE // 2)))
    rows = every.select(F.col("node").alias("group"), "vid", F.lit(1).alias("n"), blocks.alias("blocks"), "sketch")
    return _in_rooms(rows, not every.where(F.col("size") > ALONE).isEmpty(), ALONE // 2, _alike(least), "sketch")


def _linked(width: int, percent: int):
    """Links, confirmed on full sets."""

    def sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        col = textbuf.texts(batch)
        for a, b in textbuf.slices(col):
            keys, begin = shingles(*textbuf.view(col, a, b), width)
            for k in range(b - a):
                yield np.unique(keys[begin[k] : begin[k + 1]])

    class Sets:
        """The sets of a room, by numbers that are close to each other."""

        def __init__(self, room: list[Row]) -> None:
            self.sizes = np.array([len(r[3]) for r in room])
            _, self.flat = np.unique(np.concatenate([r[3] for r in room]), return_inverse=True)
            self.begin = np.cumsum(self.sizes) - self.sizes
            self.mark = np.zeros(int(self.flat.max(initial=0)) + 1, np.int64)

        def near(self, i: int, others: np.ndarray) -> np.ndarray:
            """Those of the others that are linked with i."""
            sizes, begin, mark = self.sizes, self.begin, self.mark
            # Only sets of a size that can reach the threshold are looked at.
            fits = others[(100 * sizes[others] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[others])]
            if not len(fits):
                return fits
            own = self.flat[begin[i] : begin[i] + sizes[i]]
            mark[own] = 1
            ends = np.cumsum(sizes[fits])
            at = np.repeat(begin[fits] - ends + sizes[fits], sizes[fits]) + np.arange(int(ends[-1]))
            both = np.add.reduceat(mark[self.flat[at]], ends - sizes[fits])
            mark[own] = 0
            return fits[100 * both >= percent * (sizes[fits] + sizes[i] - both)]

    def within(room: list[Row]) -> Iterator[tuple[bytes, bytes]]:
        room = list({r[0]: r for r in room}.values())
        of = Sets(room)
        left, queue = np.arange(1, len(room)), [0]
        while len(left):
            if not queue:
                queue, left = [int(left[0])], left[1:]
                continue
            i = queue.pop()
            near = of.near(i, left)
            for j in near.tolist():
                yield room[i][0], room[j][0]
            queue += near.tolist()
            left = left[~np.isin(left, near)]

    def across(room: list[Row]) -> Iterator[tuple[bytes, bytes]]:
        of, number = Sets(room), {}
        label = np.array([number.setdefault(r[2], len(number)) for r in room])
        for i, (vid, mine, _, _) in enumerate(room):
            if mine:
                for j in of.near(i, np.flatnonzero(label != label[i])).tolist():
                    yield vid, room[j][0]

    return _connecting(sets, within, across)


def _wanted(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of `docs` whose text may be a member's: they pass a Bloom filter of fixed size."""
    bit = F.pmod("text_key", F.lit(FILTER))
    words = members.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(text_key, {FILTER}) & 63 as int))").alias("mask"))
    got = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # FILTER / 64 rows at most
    bits = np.zeros(FILTER // 64, np.int64)
    bits[got.column("word").to_numpy()] = got.column("mask").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(_U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in textbuf.pieces(batch):
                at = np.mod(part.column(2).to_numpy(), FILTER)
                yield part.filter(pa.array((shared.value[at >> 6] >> (at & 63).astype(_U)) & _U(1) != 0))

    return _keyed(docs).mapInArrow(run, "text string, doc_id long, text_key long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and first_key (the text_key of the component's first row) of each row.

    Links are pairs with 100 * |A and B| >= percent * |A or B|.
    """
    rows = settle(vertices(docs, width))
    one = F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("id"), "text_key"))
    sets = rows.where(F.col("vid").isNotNull()).groupBy("vid").agg(one.alias("of"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("roots").alias("roots"))
    points = settle(sets)
    share = percent / 100
    least = share - SIGMAS * (share * (1 - share) / PLACES) ** 0.5
    family = _families(points.select("vid", "sketch", "roots"), least)
    named = family.select(F.col("a").alias("vid"), F.col("b").alias("family")).union(family.select("b", "b").distinct())
    members = settle(named.join(points.select("vid", "n", "of.id", "of.text_key"), "vid"))
    large = settle(members.groupBy(F.col("family").alias("group")).agg(F.ceil(F.sum("n") / ROOM).alias("blocks")).where(F.col("blocks") > 1))
    texts = _wanted(docs, members)
    id_ = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    of = members.select("vid", "n", F.col("family").alias("group"), "id", "text_key")
    brought = texts.withColumn("id", id_).join(of, ["id", "text_key"])
    family_rows = _salted(brought, large, "left").select("group", "vid", "n", F.coalesce("blocks", F.lit(1)).alias("blocks"), "text")
    labels = _in_rooms(family_rows, not large.isEmpty(), ROOM, _linked(width, percent), "text")
    label = labels.select(F.col("a").alias("vid"), F.col("b").alias("label"))
    ids = points.select("vid", "of").join(label, "vid", "left").withColumn("label", F.coalesce("label", "vid"))
    ids = settle(ids)
    first = settle(ids.groupBy("label").agg(F.min("of").alias("first")))
    of = ids.join(first, "label").select("vid", F.nullif("first.id", F.lit(2**63 - 1)).alias("component_id"), F.col("first.text_key").alias("first_key"))
    out = rows.where(F.col("vid").isNotNull()).select("doc_id", "text_key", "n", "vid").join(of, "vid")
    alone = rows.where(F.col("vid").isNull())
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", "first_key").union(alone.select("doc_id", "text_key", "n", "doc_id", "text_key"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each component: the least id (null last), then text hash; rows without words all stay."""
    found = near_duplicates(docs, width, percent)
    kept = found["doc_id"].eqNullSafe(found["component_id"]) & (found["text_key"] == found["first_key"])
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    gone = found.where(~kept).select(id_.alias("_id"), F.col("text_key").alias("_key")).distinct()
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("_row"), id_.alias("_id"), F.xxhash64("text").alias("_key"))
    empty = ~F.coalesce(F.col("_row")["text"], F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    left = rows.where(~empty).join(gone, ["_id", "_key"], "left_anti")
    # What is left of a component is one row and others with its id and text, of which any will do; they are reduced before they are dealt.
    one = left.groupBy("_id", "_key").agg(F.first("_row").alias("_row"))
    return one.select("_row.*").union(rows.where(empty).select("_row.*"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document, at three words and 85 of 100."""
    got = near_duplicates(table(spark, sf_dir, "documents"), 3, 85)
    return got.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP3_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
