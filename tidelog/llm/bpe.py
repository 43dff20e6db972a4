"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of the bytes before a place fires, so equal passages are cut
alike in whatever documents they stand, and each distinct chunk is encoded once in a worker; its
words come from a second, smaller-grained tier of the same kind. Chunks are joined at places where
the vocabulary's splitter always splits (one blank between two other characters), so there both
sides agree with an encoding of the whole text. A stretch of more than LONG_PIECE bytes without such
a place is cut where the hash fires, and those joins are repaired: the text from the last
pre-token before the join is encoded again until its splits agree with those after the join.

Defined results: a null or empty text has no ids and decodes to the empty text; strings of special
tokens in a text become those tokens, as the library does by default; repeated rows and rows with a
null id each get a row; texts of any length are encoded whole; an empty table gives no rows. `encode`
carries columns of any name but for the one that it adds, which is replaced; `digests` reads doc_id
and text alone. Caches are bounded (CHUNKS, PIECES; the older half goes) and only change the speed.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidelog.llm import textbuf, vocab
from tidelog.llm.tables import quoted, table

VOCABULARY = "byte_bpe_50k.json"
#: Bytes under the rolling hash; one joint in 2**RARE is a cut; entries in the caches; bytes of a piece that is cut further, and of one that is cached.
WINDOW, RARE, CHUNKS, PIECES, LONG_PIECE, SHORT = 24, 5, 1 << 15, 1 << 19, 4096, 256

_U = np.uint64
_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True
#: First bytes of two-byte characters that are never white space.
_TWO = np.zeros(256, bool)
_TWO[0xC3:0xE0] = True


def joints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places of single blanks between two characters that are certainly not white space."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data == 32)
    at = at[(at > 0) & (at < len(data) - 1)]
    before, after = data[at - 1], data[at + 1]
    good = (_PLAIN[before] | ((before >= 128) & (before < 192) & _TWO[data[np.maximum(at - 2, 0)]])) & (_PLAIN[after] | _TWO[after])
    at = at[good]
    row = np.searchsorted(off, at, "right") - 1
    return at[(at > off[row]) & (at + 1 < off[row + 1]) & ((at - 2 >= off[row]) | _PLAIN[data[at - 1]])]


def fires(data: np.ndarray, at: np.ndarray, low: np.ndarray, rare: int) -> np.ndarray:
    """Whether the hash of the WINDOW bytes before each place fires; never nearer than that to `low`."""
    far = at - low >= WINDOW
    here = np.where(far, at, WINDOW)
    if len(data) < WINDOW or not len(at):
        return np.zeros(len(at), bool)
    key = textbuf.hashes(data, here - WINDOW, here)
    return far & ((key & _U(2**rare - 1)) == 0)


def _room(cache: dict, most: int) -> None:
    """The older half of a full cache goes."""
    if len(cache) >= most:
        for key in list(itertools.islice(cache, most - most // 2)):
            del cache[key]


class Coder:
    """Encodes texts of a worker; what it has encoded it knows."""

    def __init__(self, path: str, most: int = PIECES) -> None:
        self.most, self.most_chunks = most, max(1, most * CHUNKS // PIECES)
        self.lib = vocab.tokenizer(path)
        self.split = self.lib.pre_tokenizer.pre_tokenize_str
        self.special = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.chunks: dict[bytes, tuple[bytes, bytes]] = {}
        self.pieces: dict[bytes, tuple[bytes, bytes]] = {}
        self.bytes_of = self._bytes_of()

    def _bytes_of(self) -> list[bytes]:
        """What each id stands for, in bytes: the vocabulary writes a byte as a printable character."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        added = {i: t.content for i, t in self.lib.get_added_tokens_decoder().items()}
        size = self.lib.get_vocab_size(with_added_tokens=True)
        return [added[i].encode() if i in added else bytes(byte[c] for c in self.lib.id_to_token(i)) for i in range(size)]

    def ids(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _entry(self, ids: list[int], raw: bytes) -> tuple[bytes, bytes]:
        """The ids of `raw` in decimal and what they decode to; where that is `raw`, it is held once."""
        decoded = self.decode(ids)
        return ",".join(map(str, ids)).encode(), raw if decoded == raw else decoded

    def piece(self, raw: bytes) -> tuple[bytes, bytes]:
        """A stretch between two joints."""
        found = self.pieces.get(raw)
        if found is None:
            long = len(raw) > LONG_PIECE and not any(s in raw for s in self.special)
            found = self._entry(self.repaired(raw) if long else self.ids(raw.decode()), raw)
            if len(raw) <= SHORT:
                _room(self.pieces, self.most)
                self.pieces[raw] = found
        return found

    def repaired(self, raw: bytes) -> list[int]:
        """Encode by raw chunks, then mend their joins."""
        data = np.frombuffer(raw, np.uint8)
        places = np.flatnonzero((data & 0xC0) != 0x80)  # only between characters
        at = places[fires(data, places, np.zeros(len(places), np.int64), 9)]
        ends = [*at.tolist(), len(raw)]
        rest, out = raw[: ends[0]].decode(), []
        for a, b in zip(ends, ends[1:], strict=False):
            part = raw[a:b].decode()
            # What comes before the last split ends the same in the whole text; white space at an end would not.
            tail = next((s for _, (s, _) in reversed(self.split(rest)) if s and not rest[s - 1].isspace()), 0)
            own = {s for _, (s, _) in self.split(part)}
            out += self._cached(rest[:tail])
            mend, size, agreed = rest[tail:], 32, None
            while agreed is None:
                # The last split of what is encoded again may move yet; an earlier one that both have stays.
                seen = [s - len(mend) for _, (s, _) in self.split(mend + part[:size])][:-1]
                agreed = next((s for s in seen if s > 0 and s in own and not part[s - 1].isspace()), None)
                if size >= len(part):
                    break
                size *= 4
            if agreed is None:
                rest = mend + part
            else:
                out += self._cached(mend + part[:agreed])
                rest = part[agreed:]
        return out + self._cached(rest)

    def _cached(self, text: str) -> list[int]:
        key = text.encode()
        found = self.chunks.get(key)
        if found is None:
            ids = self.ids(text)
            self._keep(key, self._entry(ids, key))
            return ids
        return [int(x) for x in found[0].split(b",")] if found[0] else []

    def _keep(self, key: bytes, entry: tuple[bytes, bytes]) -> None:
        if len(key) <= LONG_PIECE:
            _room(self.chunks, self.most_chunks)
            self.chunks[key] = entry

    def encode(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """For each text: its ids in decimal, joined by commas, and their decoded bytes."""
        raw = data.tobytes()
        at = joints(data, off)
        row = np.searchsorted(off, at, "right") - 1
        cut = np.flatnonzero(fires(data, at, off[row], RARE))
        first = np.searchsorted(at, off[:-1]).tolist()
        last = np.searchsorted(at, off[1:]).tolist()
        cut_first, cut_last = np.searchsorted(at[cut], off[:-1]).tolist(), np.searchsorted(at[cut], off[1:]).tolist()
        places, cuts, ends = at.tolist(), cut.tolist(), off.tolist()
        chunks, piece, known = self.chunks, self.piece, self.pieces
        for d in range(len(ends) - 1):
            ids, decoded = [], []
            marks = [first[d] - 1, *cuts[cut_first[d] : cut_last[d]], last[d]]
            for i, j in zip(marks, marks[1:], strict=False):
                a = ends[d] if i < first[d] else places[i]
                b = ends[d + 1] if j >= last[d] else places[j]
                key = raw[a:b]
                found = chunks.get(key)
                if found is None:
                    edges = [a, *places[i + 1 : j], b]
                    parts = [known.get(w) or piece(w) for w in map(raw.__getitem__, map(slice, edges, edges[1:]))]
                    decoded_ = b"".join([p[1] for p in parts])
                    found = b",".join([p[0] for p in parts if p[0]]), key if decoded_ == key else decoded_
                    self._keep(key, found)
                if found[0]:
                    ids.append(found[0])
                    decoded.append(found[1])
            yield b",".join(ids), b"".join(decoded)


@functools.lru_cache(2)
def coder(path: str, most: int = PIECES) -> Coder:
    return Coder(path, most)


def _runs(batches: Iterator[pa.RecordBatch], path: str, text: str = "text", most: int = PIECES) -> Iterator[tuple[pa.RecordBatch, int, int, list[tuple[bytes, bytes]]]]:
    own = coder(path, most)
    for batch in batches:
        col = textbuf.texts(batch, text)
        for a, b in textbuf.slices(col):
            yield batch, a, b, list(own.encode(*textbuf.view(col, a, b)))


def encode(docs: DataFrame, path: str, ids: str = "ids", most: int = PIECES) -> DataFrame:
    """All columns of `docs` and the ids of `text` as an array (a column called so is replaced).

    A worker remembers `most` pieces, and chunks in proportion: about 400 bytes each.
    """
    kept = [c for c in docs.columns if c != ids]
    names = [f"c{i}" for i in range(len(kept))]  # by place, so that any name will do
    plain, text = docs.select(*quoted(kept)).toDF(*names), f"c{kept.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, got in _runs(batches, path, text, most):
            values = [np.fromstring(x.decode(), np.int32, sep=",") if x else np.zeros(0, np.int32) for x, _ in got]
            ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, lists], [*names, "ids"])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])).toDF(*kept, ids)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, got in _runs(batches, path):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).slice(a, b - a),
                    pa.array([x.count(b",") + 1 if x else 0 for x, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x, _ in got], pa.string()),
                    pa.array([hashlib.sha256(y).hexdigest() for _, y in got], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("text", "doc_id").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    return digests(table(spark, sf_dir, "documents"), vocab.public(VOCABULARY))
