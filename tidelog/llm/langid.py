"""Language ID by bit-sliced Bloom filters over byte n-grams.

One table of 64-bit words holds a Bloom filter for each language, transposed: bit l of every word
belongs to language l, so ANDing the words at an n-gram's hash positions gives the set of all
languages that contain it. A text's score for a language is the number of its n-grams with that
bit, corrected for the filter's rate of false positives; the largest count decides. The counts of
64 languages come from eight histograms of the mask's bytes, so time doesn't grow with each language.

Learning reads at most MAX_ROWS documents (a documented sample, by a hash of the id), so no more than
as many languages can be learnt; one that no row of the sample has isn't. Shares of n-grams are
computed by Spark; the driver gets the filled words alone, of which there are TABLE at most. A language
keeps the n-grams that make up a part LEAST of all its own or more, so a language with little text
keeps all, and none keeps more than 1 / LEAST. Filters have EIGHT times as many bits as the largest
has n-grams, as far as TABLE lets them: with very many languages they get fuller.

Defined results: `und` with score 0 for a null text, a text without a letter, or where nothing has
been learnt; a tie goes to the language whose name sorts first; a text none of whose n-grams is
known gets the most frequent language of the sample with score 0. Repeated rows each get a row; rows
with a null id count as not held out and are not learnt from; rows with a null text or lang teach
nothing. Texts of any length are read whole, in slices. An empty table gives no rows. Columns besides
doc_id, text and lang are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import textbuf
from tidelog.llm.tables import held_out, sampled, settle, table

#: Fitting reads at most so many documents (whole texts), chosen by a hash of their ids.
MAX_ROWS = 20_000
#: Least part of a language's n-grams that one must make up to be kept.
LEAST = 1 / (1 << 17)
#: A language contains an n-gram if its share there is at least this part of the largest share.
PART = 0.25
LENGTHS = (3, 5)
#: Bits of a filter for each n-gram, hash functions; 64-bit words of all tables together.
EIGHT, HASHES, TABLE = 8, 3, 1 << 23

_U = np.uint64
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased texts, and each one's row. Runs of other bytes count as one space."""
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    plain = _LETTER[data]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = plain != 0
    keep[1:] |= (plain[:-1] != 0) & (row[1:] == row[:-1])  # the first space after a word
    plain, row = plain[keep], row[keep]
    start = np.ones(len(row), bool)
    start[1:] = row[1:] != row[:-1]
    if start.any():  # a space before the first word of each row
        at = np.flatnonzero(start)
        plain, row = np.insert(plain, at, 0), np.insert(row, at, row[at])
    out, rows = [], []
    wide = plain.astype(_U)
    for size in LENGTHS:
        if len(plain) < size:
            continue
        key = np.full(len(plain) - size + 1, size, _U)
        for i in range(size):
            key = (key << _U(8)) | wide[i : len(wide) - size + 1 + i]
        inside = row[: len(row) - size + 1] == row[size - 1 :]
        out.append(key[inside])
        rows.append(row[: len(row) - size + 1][inside])
    if not out:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return textbuf.mix(np.concatenate(out)), np.concatenate(rows)


_BYTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)


def popcounts(mask: np.ndarray, row: np.ndarray, n: int, bits: int = 64) -> np.ndarray:
    """For each of `bits` bits and n rows, in how many of the row's masks the bit is set."""
    out = np.zeros((bits, n))
    for byte in range(-(-bits // 8)):
        value = ((mask >> _U(8 * byte)) & _U(255)).astype(np.int64)
        for a in range(0, n, 4096):  # 4096 rows of histograms at once
            lo, hi = np.searchsorted(row, (a, a + 4096)) if n > 4096 else (0, len(row))
            some = min(4096, n - a)
            seen = np.bincount((row[lo:hi] - a) * 256 + value[lo:hi], minlength=some * 256).reshape(some, 256) @ _BYTES
            out[8 * byte : 8 * byte + 8, a : a + some] = seen.T[: bits - 8 * byte]
    return out


@dataclass
class Filters:
    names: list[str]
    bits: int
    tables: list[np.ndarray]
    false: np.ndarray
    common: int

    def counts(self, key: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """For each language and row, how many of its n-grams the filter has, less those expected by chance. Rows must rise."""
        total, found = np.bincount(row, minlength=n), []
        at = positions(key, self.bits)
        for t, words in enumerate(self.tables):
            mask = words[at[0]]
            for more in at[1:]:
                mask = mask & words[more]
            found.append(popcounts(mask, row, n, min(64, len(self.names) - 64 * t)))
        count = np.concatenate(found)
        return np.maximum((count - total * self.false[:, None]) / (1 - self.false[:, None]), 0)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language of each text and its score."""
        n = len(offsets) - 1
        count = self.counts(*grams(data, offsets), n)
        best, sums = count.argmax(0), count.sum(0)
        score = np.divide(count.max(0), sums, out=np.zeros(n), where=sums > 0)
        return np.where(sums > 0, best, self.common), score


def positions(key: np.ndarray, bits: int) -> list[np.ndarray]:
    """HASHES places of 2 ** `bits`, by double hashing."""
    with np.errstate(over="ignore"):
        return [((key + _U(i) * ((key >> _U(32)) | _U(1))) & _U(2**bits - 1)).astype(np.int64) for i in range(HASHES)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of each language, summed over a slice."""
    for batch in batches:
        col = pc.utf8_lower(textbuf.texts(batch))
        lang = batch.column(batch.schema.get_field_index("lang")).dictionary_encode()
        code, names = lang.indices.to_numpy(zero_copy_only=False), lang.dictionary.to_pylist()
        for a, b in textbuf.slices(col):
            key, row = grams(*textbuf.view(col, a, b))
            of = code[a:b][row]
            order = np.argsort(of, kind="stable")
            present, first = np.unique(of[order], return_index=True)
            for i, keys in zip(present.tolist(), np.split(key[order], first[1:]) if len(key) else (), strict=True):
                g, c = np.unique(keys, return_counts=True)
                name = names[i]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], ["lang", "gram", "times"])


def shares(docs: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[tuple[str, int]], DataFrame]:
    """The languages of the sample and their documents, and (number of the language, gram) for the n-grams that it contains."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    rows = settle(sampled(known.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), max_rows, "text", "lang"))
    langs = [(r[0], r[1]) for r in rows.groupBy("lang").count().orderBy("lang").collect()]  # max_rows at most
    number = docs.sparkSession.createDataFrame([(name, i) for i, (name, _) in enumerate(langs)], "lang string, number int")
    counts = rows.mapInArrow(_counts, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    counts = settle(counts.join(F.broadcast(number), "lang").select("number", "gram", "times"))  # a row a language
    sums = counts.groupBy("number").agg(F.sum("times").alias("total"))
    parts = counts.join(F.broadcast(sums), "number").select("number", "gram", (F.col("times") / F.col("total")).alias("share")).where(F.col("share") >= LEAST)
    largest = parts.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("number", "share")).alias("of"))  # a gram has as many as languages
    return langs, largest.select("gram", "most", F.explode("of").alias("x")).where(F.col("x.share") >= PART * F.col("most")).select("x.number", "gram")


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> Filters:
    """Learn from documents with text and lang that are not held out, `max_rows` of them at most."""
    langs, has = shares(docs, max_rows)
    has = settle(has)
    most = has.groupBy("number").count().agg(F.max("count")).first()[0] or 0
    tables = -(-len(langs) // 64)
    bits = max(8, min((EIGHT * most).bit_length(), (TABLE // max(tables, 1)).bit_length() - 1))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, key = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(_U)
            for at in positions(key, bits):
                yield pa.RecordBatch.from_arrays([pa.array(number // 64), pa.array(at), pa.array((_U(1) << (number % 64).astype(_U)).view(np.int64))], ["table", "at", "mask"])

    words = has.mapInArrow(places, "table int, at long, mask long").groupBy("table", "at").agg(F.bit_or("mask").alias("mask")).toArrow()  # TABLE rows at most
    table_, at, mask = (words.column(c).to_numpy() for c in ("table", "at", "mask"))
    filled = []
    for t in range(tables):
        word = np.zeros(2**bits, _U)
        word[at[table_ == t]] = mask[table_ == t].view(_U)
        filled.append(word)
    names = [name for name, _ in langs]
    fill = np.concatenate([popcounts(w, np.zeros(len(w), np.int64), 1, min(64, len(names) - 64 * t))[:, 0] for t, w in enumerate(filled)]) / 2**bits if filled else np.zeros(0)
    common = max(range(len(names)), key=lambda i: langs[i][1], default=0)
    return Filters(names, bits, filled, np.minimum(fill**HASHES, 0.9), common)


def detect(spark: SparkSession, docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of each row of `docs`."""
    shared = spark.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            raw = textbuf.texts(batch)
            col = pc.utf8_lower(raw)
            for a, b in textbuf.slices(col):
                data, off = textbuf.view(col, a, b)
                part = raw.slice(a, b - a)
                ascii_ = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data >= 97) & (data <= 122), out=ascii_[1:])
                letters = ascii_[off[1:]] > ascii_[off[:-1]]
                for i in np.flatnonzero(~letters):
                    letters[i] = any(c.isalpha() for c in part[int(i)].as_py())
                if f.names:
                    best, score = f.predict(data, off)
                    names = np.array(f.names, object)[best]
                else:
                    letters[:], names, score = False, np.full(b - a, "und", object), np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(np.where(letters, names, "und").tolist(), pa.string()), pa.array(np.where(letters, np.clip(score, 0, 1), 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.select("text", "doc_id").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = detect(spark, docs, fit(docs))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
