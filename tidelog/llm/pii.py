"""Personal data: base patterns, and terms that disclose what the patterns protect.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Protected entities c are each
distinct value (an address) and each kind as a whole (that a text holds an address at all). After
C-sanitisation (Sanchez and Batet, 2016), a term t discloses c where PMI(c; t) >= ALPHA * IC(c), with
IC(c) = -log2 p(c), PMI = log2(p(c, t) / (p(c) p(t))), and probabilities that are shares of all
documents of the corpus: c and t meet in a document if both stand anywhere in it, t outside base
spans. So t discloses c where p(c | t) >= p(c) ** (1 - ALPHA): of a value that stands in one document
that makes the terms that stand in no more than n ** (1 - ALPHA) of the n documents, its own one
among them. A kind also needs SUPPORT documents with both.

Terms that disclose a kind, or a value of one document, become spans of kind `term` in the documents
that hold it; those that disclose a value of several documents in all documents with base spans, and
where FAR documents have both, in all documents: a few that meet by chance, or copies of a passage, say
nothing about a text that has no personal data of its own. The sanitised text has a class name in place of a span, or nothing for a term all of whose
documents hold an entity that it discloses.

One pass counts each term's documents, and those with each kind; sums are made before they are
shuffled. A term whose share of documents with some kind is below n ** (ALPHA - 1) can't disclose
anything: the HARMLESS most frequent ones of these are known everywhere, and the other terms of texts
with base spans are joined with the counts. Only values and terms of several documents are paired,
text by text; equal texts are one row with a number.

Defined results: a null or empty text has no spans; repeated rows each get a row (and each count as a
document), also with a null id; a text of any length is worked on whole, in time in proportion to its
length but for the pairs of repeated values and rare repeated terms in it; a table of one document
discloses nothing; an empty table gives no rows; terms are runs of at least SHORTEST bytes of ASCII
letters and non-ASCII characters, ASCII in lower case; overlapping spans are replaced as one, named
by the first. `find` reads doc_id and text alone; `sanitise` keeps all other columns, whatever their
names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tidelog.llm import textbuf
from tidelog.llm.tables import settle, table

KINDS = ("email", "ip", "card", "phone")
#: Share of an entity's information at which a term discloses it, documents that a kind and a term must share, and a value and a term for texts without base spans, bytes of a term.
ALPHA, SUPPORT, FAR, SHORTEST = 0.95, 3, 10, 3
#: Terms at most in a list that is known everywhere; terms of a task after which its sums are given out; parts that the rows of one text are dealt to.
HARMLESS, HELD, SALT = 1 << 17, 1 << 18, 16

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits starts where no digit stands before; else a match would have begun earlier.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

Span = tuple[int, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(start, place in KINDS, end) by start and kind."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _digits(m.group()) if m.end() - m.start() >= 12 else ""
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and hashes of the terms of a slice."""
    a, b, row = textbuf.runs(_LETTER[data], off)
    long = b - a >= SHORTEST
    a, b, row = a[long], b[long], row[long]
    return a, b, row, textbuf.hashes(textbuf.lowered(data), a, b).view(np.int64)


def _points(data: np.ndarray, *places: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places in the bytes of a text as code points."""
    point = np.flatnonzero((data & 0xC0) != 0x80)
    return places if len(point) == len(data) else tuple(np.searchsorted(point, x) for x in places)


def _inside(a: np.ndarray, b: np.ndarray, spans: list[Span]) -> np.ndarray:
    """Which of the terms from a to b overlap a span."""
    out = np.zeros(len(a), bool)
    for s, _, e in spans:
        out[np.searchsorted(b, s, "right") : np.searchsorted(a, e)] = True
    return out


def entities(text: str, spans: list[Span]) -> list[int]:
    """The distinct values of the spans, as numbers."""
    return sorted({_number(f"{KINDS[k]}:{text[a:b].lower() if k < 2 else _digits(text[a:b])}") for a, k, b in spans})


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"))


_SCAN = "doc_id long, text_key binary, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = textbuf.texts(batch)
        for a, b in textbuf.slices(col):
            rows = []
            for text in col.slice(a, b - a).to_pylist():
                spans = base_spans(text)
                count = [0, 0, 0, 0]
                for _, k, _ in spans:
                    count[k] += 1
                rows.append((*count, written(spans), entities(text, spans)))
            part = batch.slice(a, b - a)
            counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *counts, pa.array([r[4] for r in rows], pa.string()), pa.array([r[5] for r in rows], pa.list_(pa.int64()))], ["doc_id", "text_key", *(f"n_{k}" for k in KINDS), "base", "entities"])


def scan(docs: DataFrame) -> DataFrame:
    """Base spans of each row, and its entities."""
    return _keyed(docs).mapInArrow(_scanned, _SCAN)


class Slice:
    """The terms of a slice that lie in no base span, by row: places in bytes and hashes; and the base spans of each row that has some."""

    def __init__(self, col: pa.Array, a: int, b: int) -> None:
        self.data, self.off = textbuf.view(col, a, b)
        start, end, row, key = _terms(self.data, self.off)
        free, self.spans = np.ones(len(key), bool), {}
        for i, text in enumerate(col.slice(a, b - a).to_pylist()):
            spans = base_spans(text)
            if spans:
                self.spans[i] = spans
                lo, hi = np.searchsorted(row, (i, i + 1))
                free[lo:hi] = ~_inside(*self._within(i, start[lo:hi], end[lo:hi]), spans)
        self.start, self.end, self.row, self.key = start[free], end[free], row[free], key[free]

    def _within(self, i: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        at = self.off[i]
        return _points(self.data[at : self.off[i + 1]], start - at, end - at)

    def places(self, i: int, wanted: np.ndarray) -> tuple[list[int], list[list[int]], list[list[int]]]:
        """The distinct terms of row i that `wanted` (a flag a term) marks, and where each stands in code points."""
        lo, hi = np.searchsorted(self.row, (i, i + 1))
        pick = lo + np.flatnonzero(wanted[lo:hi])
        if not len(pick):
            return [], [], []
        start, end = self._within(i, self.start[pick], self.end[pick])
        order = np.argsort(self.key[pick], kind="stable")
        terms, first = np.unique(self.key[pick][order], return_index=True)
        cut = lambda x: [p.tolist() for p in np.split(x[order], first[1:])]
        return terms.tolist(), cut(start), cut(end)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first, axis=0) if len(keys) else counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, documents, and documents with each kind, summed over a task or HELD terms of it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> Iterator[pa.RecordBatch]:
        keys, counts = held[0]
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), *(pa.array(c[i : i + (1 << 16)]) for c in counts.T)], ["term", "docs", *(f"n_{k}" for k in KINDS)])

    for batch in batches:
        col = textbuf.texts(batch)
        for a, b in textbuf.slices(col):
            found = Slice(col, a, b)
            flags = np.zeros((b - a, 5), np.int64)
            flags[:, 0] = 1
            for i, spans in found.spans.items():
                flags[i, [k + 1 for _, k, _ in spans]] = 1
            order = np.argsort(found.key, kind="stable")  # rows stay in order inside
            key, row = found.key[order], found.row[order]
            new = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])) if len(key) else np.zeros(0, bool)
            held.append(_summed(key[new], flags[row[new]]))
            if sum(len(k) for k, _ in held) > HELD:
                held = [_summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                if len(held[0][0]) > HELD // 2:
                    yield from out()
                    held = []
    if held:
        held = [_summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
        yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, docs, n_email, n_ip, n_card, n_phone): each term's documents, and those that hold a kind."""
    names = ["docs", *(f"n_{k}" for k in KINDS)]
    parts = docs.select("text").mapInArrow(_counted, ", ".join(f"{c} long" for c in ["term", *names]))
    return parts.groupBy("term").agg(*(F.sum(c).alias(c) for c in names))


def _inside_of(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of the keys are in the sorted array."""
    if not len(some):
        return np.zeros(len(keys), bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def _lists(col: pa.Array, *fields: str) -> tuple[list[int], ...]:
    """Where each row's list begins (one more at the end), and the fields of the structs of all lists."""
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    flat = col.flatten()
    return (np.append(0, np.cumsum(size)).tolist(), *(pc.struct_field(flat, f).to_numpy(zero_copy_only=False) for f in fields))


#: Rows whose lists are Python's at once.
FEW = 256


class Disclosure:
    """What the corpus says of its terms: all that the operators need of it, written."""

    def __init__(self, docs: DataFrame, scanned: DataFrame) -> None:
        self.docs, self.spark = docs, docs.sparkSession
        self.total = docs.count()
        row = scanned.agg(*(F.count_if(F.col(f"n_{k}") > 0).alias(k) for k in KINDS)).first()
        self.kinds = {k: int(row[k]) for k in KINDS}
        terms = settle(term_counts(docs))
        most = F.greatest(*(F.col(f"n_{k}") for k in KINDS)) / F.col("docs")
        possible = most >= max(self.total, 1) ** (ALPHA - 1) * (1 - 1e-9)
        self.candidates = terms.where(possible)
        known = terms.where(~possible).orderBy(F.desc("docs"), "term").limit(HARMLESS).select("term").toArrow()  # HARMLESS rows at most
        self.harmless = self.spark.sparkContext.broadcast(np.sort(known.column("term").to_numpy()))
        some = scanned.where(F.size("entities") > 0)
        mask = sum((F.col(f"n_{k}") > 0).cast("int") * 2**i for i, k in enumerate(KINDS))
        texts = some.groupBy("text_key").agg(F.count("*").alias("times"), F.first("entities").alias("entities"), F.first(mask).alias("kinds"))
        each = settle(texts.select("text_key", "times", "kinds", F.explode("entities").alias("entity")))
        # Written first: Spark splits a hot entity in the join only if no aggregate stands before it.
        self.entities = settle(each.groupBy("entity").agg(F.sum("times").alias("entity_docs")))
        several = F.when(F.col("entity_docs") > 1, F.struct("entity", "entity_docs"))
        self.texts = settle(each.join(self.entities, "entity").groupBy("text_key", "times", "kinds").agg(F.max(F.col("entity_docs") == 1).alias("single"), F.collect_list(several).alias("several")))
        self.found = settle(self._placed(True, self.candidates).groupBy("text_key", "term", "docs", *(f"n_{k}" for k in KINDS)).agg(F.first("places").alias("places")))
        self.paired = settle(self._paired())
        self.far = self.paired.where("far").select("term", "certain")
        n = self.far.count()
        # Few terms are looked for one by one; else all that aren't harmless are, and joined.
        few = np.sort(self.far.select("term").toArrow().column("term").to_numpy()) if n <= HARMLESS else None
        self.any, self.few = n > 0, self.spark.sparkContext.broadcast(few)

    def reached(self, pair: Column, entity: Column) -> Column:
        """Whether PMI reaches ALPHA of the entity's information; `docs` are the term's."""
        share = F.log2(entity / float(max(self.total, 1)))
        return (share < 0) & (F.log2(pair * float(max(self.total, 1)) / (entity * F.col("docs"))) >= -ALPHA * share - 1e-9)

    def _placed(self, protected: bool, terms: DataFrame) -> DataFrame:
        """text_key, term, places and the columns of `terms`, for the texts with base spans or for the others."""
        harmless, few = self.harmless, None if protected else self.few

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                col = textbuf.texts(batch)
                for a, b in textbuf.slices(col):
                    found = Slice(col, a, b)
                    listed = few.value if few is not None else None
                    wanted = _inside_of(found.key, listed) if listed is not None else ~_inside_of(found.key, harmless.value)
                    keys, names, places = [], [], []
                    for i in np.unique(found.row[wanted]).tolist():
                        if protected == (i in found.spans):
                            got, start, stop = found.places(i, wanted)
                            keys += [batch.column(2)[a + i].as_py()] * len(got)
                            names += got
                            places += [[{"start": s, "stop": e} for s, e in zip(x, y, strict=True)] for x, y in zip(start, stop, strict=True)]
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(names, pa.int64()), pa.array(places, kind)], ["text_key", "term", "places"])

        rows = _keyed(self.docs)
        if protected:
            rows = rows.where(F.col("text").rlike("[@0-9]"))
        return rows.mapInArrow(run, "text_key binary, term long, places array<struct<start:int,stop:int>>").join(terms, "term")

    def _paired(self) -> DataFrame:
        """(term, certain, far): the terms of several documents that disclose a value of several documents."""
        total, alpha = float(max(self.total, 1)), ALPHA
        terms = self.found.where(F.col("docs") > 1).groupBy("text_key").agg(F.collect_list(F.struct("term", "docs")).alias("terms"))
        both = self.texts.where(F.size("several") > 0).join(terms, "text_key").select("times", "several", "terms")

        def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Values and terms of a text, where the term isn't in too many documents for the value."""
            for batch in batches:
                times = batch.column(0).to_pylist()
                c_at, c, c_docs = _lists(batch.column(1), "entity", "entity_docs")
                t_at, t, t_docs = _lists(batch.column(2), "term", "docs")
                for r in range(batch.num_rows):
                    terms, docs = t[t_at[r] : t_at[r + 1]], t_docs[t_at[r] : t_at[r + 1]]
                    for i in range(c_at[r], c_at[r + 1]):
                        got = terms[docs <= total * (c_docs[i] / total) ** alpha * (1 + 1e-9)]
                        if len(got):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), c[i])), pa.array(got), pa.array(np.full(len(got), times[r]))], ["entity", "term", "times"])

        pairs = both.mapInArrow(paired, "entity long, term long, times long").groupBy("entity", "term").agg(F.sum("times").alias("pair_docs"))
        scored = pairs.join(self.entities, "entity").join(self.candidates.select("term", "docs"), "term")
        scored = scored.where(self.reached(F.col("pair_docs"), F.col("entity_docs")))
        return scored.groupBy("term").agg(F.max(F.col("pair_docs") >= F.col("docs")).alias("certain"), F.max(F.col("pair_docs") >= FAR).alias("far"))

    def spans(self) -> DataFrame:
        """(text_key, terms): the spans that the method adds to a text, by start."""
        met = [(F.col("kinds").bitwiseAND(2**i) != 0) & (F.col(f"n_{k}") >= SUPPORT) & self.reached(F.col(f"n_{k}"), F.lit(self.kinds[k])) for i, k in enumerate(KINDS)]
        all_ = [m & (F.col(f"n_{k}") == F.col("docs")) for m, k in zip(met, KINDS, strict=True)]
        single = (F.col("docs") == 1) & (F.lit(self.total) > 1) | F.col("single") & self.reached(F.lit(1), F.lit(1))
        rows = self.found.join(self.texts.select("text_key", "kinds", "single"), "text_key").join(self.paired.select("term", "certain", F.lit(True).alias("paired")), "term", "left")
        hit = single | F.coalesce("paired", F.lit(False))
        certain = (F.col("docs") == 1) | F.coalesce("certain", F.lit(False))
        for m, c in zip(met, all_, strict=True):
            hit, certain = hit | m, certain | c
        rows = rows.where(hit).select("text_key", "places", certain.alias("certain"))
        if self.any:
            others = self._placed(False, self.far).select("text_key", "places", "certain")
            rows = rows.union(others.groupBy("text_key", "places").agg(F.first("certain").alias("certain")))
        each = F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), F.col("certain").alias("certain")))
        return rows.select("text_key", each.alias("x")).groupBy("text_key").agg(F.array_sort(F.flatten(F.collect_list("x"))).alias("terms"))


_TERMS = "array<struct<start:int,stop:int,certain:boolean>>"


def _joined(rows: DataFrame, spans: DataFrame, key: str, moved: bool = False) -> DataFrame:
    """`rows` with `_terms`, dealt so that a text that stands in many rows is no single task's."""
    few = spans.select(F.col("text_key").alias("_text_key"), F.col("terms").alias("_terms"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_part"))
    dealt = rows.withColumn("_at", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
    if moved:  # what comes before and after are Python's, which would have two workers for each task in one stage
        dealt = dealt.repartition(key, "_at")
    return dealt.join(few, (dealt[key] == few["_text_key"]) & (dealt["_at"] == few["_part"]), "left").drop("_text_key", "_part", "_at")


def find(docs: DataFrame) -> DataFrame:
    """Each row's counts, base spans and all spans; `base` and `spans` are kind:start:end by start and kind."""
    scanned = settle(scan(docs))
    spans = Disclosure(docs, scanned).spans()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, FEW) for b in batches for i in range(0, b.num_rows, FEW)):
            out = []
            for base, terms in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                each = [(int(s.split(":")[1]), KINDS.index(s.split(":")[0]), s) for s in base.split(",")] if base else []
                each += [(t["start"], len(KINDS), f"term:{t['start']}:{t['stop']}") for t in terms or ()]
                out.append(",".join(s for _, _, s in sorted(each)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out, pa.string())], [*batch.schema.names[:6], "spans"])

    shown = ["doc_id", *(f"n_{k}" for k in KINDS), "base"]
    rows = _joined(scanned.select(*shown, "text_key"), spans, "text_key").select(*shown, "_terms")
    return rows.mapInArrow(merged, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


_PUT = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def replaced(text: str, terms: list[dict] | None) -> str:
    """The text with class names in place of spans; overlapping spans are one, named by the first."""
    spans = [(a, b, _PUT[KINDS[k]]) for a, k, b in base_spans(text)] + [(t["start"], t["stop"], "" if t["certain"] else "[TERM]") for t in terms or ()]
    out, at = [], 0
    for a, b, name in sorted(spans, key=lambda s: s[:2]):
        if a >= at:
            out += [text[at:a], name]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with `text` sanitised; other columns stay. Texts without a digit, @ or term that is looked for are not moved."""
    columns, at = docs.columns, docs.columns.index("text")
    scanned = settle(scan(docs))
    known = Disclosure(docs, scanned)
    # Columns go by place from here on, so none of any name can clash.
    names = [f"c{i}" for i in range(len(columns))]
    plain, text = docs.toDF(*names), f"c{at}"
    schema, any_, few, harmless = plain.schema, known.any, known.few, known.harmless

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, col in textbuf.pieces(batch, text):
                has = np.zeros(len(col), bool)
                _, _, row, key = _terms(*textbuf.view(col, 0, len(col)))
                has[row[_inside_of(key, few.value) if few.value is not None else ~_inside_of(key, harmless.value)]] = True
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(has)], [*names, "_has"])

    marked = plain.mapInArrow(mark, StructType([*schema.fields, StructField("_has", BooleanType())])) if any_ else plain.withColumn("_has", F.lit(False))
    has = F.col("_has") | F.coalesce(F.col(text).rlike("[@0-9]"), F.lit(False))
    some = marked.where(has).drop("_has").withColumn("_key", F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    some = _joined(some, known.spans(), "_key", any_).drop("_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, FEW) for b in batches for i in range(0, b.num_rows, FEW)):
            texts, terms = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            put = pa.array([None if t is None else replaced(t, x) for t, x in zip(texts, terms, strict=True)], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([put if i == at else batch.column(i) for i in range(len(names))], names)

    return some.mapInArrow(run, schema).union(marked.where(~has).drop("_has")).toDF(*columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every document."""
    got = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
