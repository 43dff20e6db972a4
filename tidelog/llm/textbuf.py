"""Vectorised work on the UTF-8 buffers of Arrow string columns.

Everything here sees a slice of a column as one byte array and the offsets of its
rows, so that a batch of documents costs a fixed number of numpy calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows are worked on in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_POW = np.ones(1, _U)
_INV = np.ones(1, _U)


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together (or of one row)."""
    ends = offsets_of(col)
    n, at = len(col), 0
    while at < n:
        stop = int(np.searchsorted(ends, ends[at] + limit, "right")) - 1
        stop = min(n, max(stop, at + 1))
        yield at, stop
        at = stop


def pieces(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch with at most `limit` bytes of text each (or one row), and their texts: what is given back in parts is never held as a whole."""
    col = texts(batch, name)
    for a, b in slices(col, limit):
        yield batch.slice(a, b - a), col.slice(a, b - a)


def offsets_of(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind, len(col) + 1, col.offset * kind().itemsize).astype(np.int64)


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column as an Arrow string array without nulls (null becomes empty)."""
    col = batch.column(batch.schema.get_field_index(name))
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    return col.fill_null("") if col.null_count else col


def view(col: pa.Array, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of the rows start..stop."""
    off = offsets_of(col)[start : stop + 1]
    raw = col.buffers()[2]
    if raw is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(raw, np.uint8)[off[0] : off[-1]], off - off[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _POW = np.concatenate([np.ones(1, _U), np.cumprod(np.full(size, _BASE, _U))])
            _INV = np.concatenate([np.ones(1, _U), np.cumprod(np.full(size, _BASE_INV, _U))])
    return _POW[:n], _INV[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 one)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _BASE) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the runs of non-white bytes; runs end where a row ends."""
    return runs(~_SPACE[data], offsets)


def runs(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the runs of true; runs end where a row ends."""
    data = solid
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, _U)
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
