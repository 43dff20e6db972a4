"""Token counts by a two-tier lookup of pre-token lengths, on the side of the map.

Tier one is a compact hash table of frequent pre-tokens, broadcast with a fixed bound of FREQUENT
entries. It is made from a sample of SAMPLE documents at most (whole texts, chosen by a hash of the
id), which LOADS tasks count; the driver merges their summaries. Tier two is a bounded cache in each
worker, which lives on from task to task: pre-tokens that the table lacks are encoded by the library
once and remembered; when it is full the older half goes. No pre-token is shuffled. Whether a
pre-token is in the table or the cache changes the speed, never a count.

A pre-token is here a maximal run without white space: the vocabulary's normaliser and splitter
drop white space and never join across it, so a text has as many tokens as its runs together.
Texts where that can't be relied on (special strings, control characters that Python alone takes
for white space) go to the library whole.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows and rows with a null id
each get a row; texts of any length are counted whole; a run longer than LONG characters is encoded
each time and not cached; an empty table gives no rows. Columns besides doc_id and text are not read,
whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import textbuf, vocab
from tidelog.llm.tables import sampled, table

VOCABULARY = "word_bpe_49k.json"
#: Entries of the table; documents of the sample and tasks that count them; words counted in a task, at most; entries of the cache; characters of a run that is remembered.
FREQUENT, SAMPLE, LOADS, COUNTED, CACHED, LONG = 1 << 16, 4096, 8, 1 << 18, 1 << 19, 200

#: Characters that str.split() alone takes for white space, and the start of the special strings.
_ODD = re.compile("[\x1c-\x1f]|<\\|")


class Table:
    """What is broadcast: the frequent pre-tokens' bytes end to end, where each starts, and its length in tokens; a worker hashes it once."""

    def __init__(self, words: list[str], lengths: list[int]) -> None:
        raw = [w.encode() for w in words]
        self.bytes = b"".join(raw)
        self.starts = np.cumsum([0, *map(len, raw)]).astype(np.uint32)
        self.lengths = np.array(lengths, np.uint16)

    def load(self) -> dict[str, int]:
        cut = self.starts.tolist()
        return {self.bytes[a:b].decode(): n for a, b, n in zip(cut, cut[1:], self.lengths.tolist(), strict=False)}


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's most frequent pre-tokens, from a counter that is thinned when it grows too large."""
    seen: Counter[str] = Counter()
    for batch in batches:
        col = textbuf.texts(batch)
        for a, b in textbuf.slices(col, 4 << 20):
            for text in col.slice(a, b - a).to_pylist():
                seen.update(text.split())
            if len(seen) > 2 * COUNTED:
                seen = Counter(dict(seen.most_common(COUNTED)))
    top = [(w, n) for w, n in seen.most_common(FREQUENT) if len(w) <= LONG and not _ODD.search(w)]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "times"])


def frequent(docs: DataFrame, path: str, size: int = FREQUENT) -> Table:
    """The table for a corpus: the `size` most frequent pre-tokens of the sample."""
    rows = sampled(docs.select("doc_id", "text"), SAMPLE, "text").repartition(LOADS)
    got = rows.mapInArrow(_summaries, "word string, times long").toArrow()  # LOADS * FREQUENT rows at most
    seen: Counter[str] = Counter()
    for w, n in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        seen[w] += n
    words = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:size]]
    return Table(words, [min(len(e.ids), 65535) for e in vocab.tokenizer(path).encode_batch(words, add_special_tokens=False)])


class Counts:
    """Both tiers in a worker."""

    def __init__(self, first: Table, path: str) -> None:
        self.known, self.coder = first.load(), vocab.tokenizer(path)  # the table's entries come first
        self.first = len(self.known)

    def whole(self, text: str) -> int:
        return len(self.coder.encode(text, add_special_tokens=False).ids)

    def count(self, part: list[str]) -> list[int]:
        runs = [None if _ODD.search(t) else t.split() for t in part]
        missing = set().union(*(r for r in runs if r)).difference(self.known)
        if missing:
            if len(self.known) + len(missing) > self.first + CACHED:
                entries = list(self.known.items())
                self.known = dict(entries[: self.first] + entries[self.first + CACHED // 2 :])  # the older half goes
                missing = set().union(*(r for r in runs if r)).difference(self.known)
            words = list(missing)
            for i in range(0, len(words), 4096):
                block = words[i : i + 4096]
                self.known.update(zip(block, (len(e.ids) for e in self.coder.encode_batch(block, add_special_tokens=False)), strict=True))
        length = self.known.__getitem__
        out = [self.whole(t) if r is None else sum(map(length, r)) for t, r in zip(part, runs, strict=True)]
        for w in missing:
            if len(w) > LONG:
                del self.known[w]
        return out


_WORKER: dict[str, Counts] = {}


def _tiers(shared, path: str) -> Counts:
    """Both tiers for a broadcast table: one object in a worker, whatever tasks it runs."""
    if shared.id not in _WORKER:
        _WORKER.clear()
        _WORKER[shared.id] = Counts(shared.table.value, path)
    return _WORKER[shared.id]


@dataclass
class Shared:
    """A broadcast table and its number among those of the application."""

    id: str
    table: Broadcast


def count(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row of `docs`."""
    shared = Shared(uuid.uuid4().hex, spark.sparkContext.broadcast(frequent(docs, path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiers = _tiers(shared, path)
        for batch in batches:
            col = textbuf.texts(batch)
            for a, b in textbuf.slices(col):
                part = col.slice(a, b - a).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(np.diff(textbuf.offsets_of(col)[a : b + 1])), pa.array(tiers.count(part), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("text", "doc_id").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""
    got = count(spark, table(spark, sf_dir, "documents"), vocab.public(VOCABULARY))
    return got.withColumn("over_limit", F.col("n_tokens") > 2048)
