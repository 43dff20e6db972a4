"""Compression of values. Codecs whose library is missing fall back to gzip, as does an error to the raw bytes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CODECS = ("none", "gzip", "snappy", "lz4", "zstd")


def _arrow(name: str) -> tuple[Callable[[bytes], bytes], Callable[[bytes, int], bytes]] | None:
    kind = {"lz4": "lz4_raw"}.get(name, name)
    if not pa.Codec.is_available(kind):
        return None
    codec = pa.Codec(kind)
    return (lambda b: codec.compress(b, asbytes=True)), (lambda b, n: codec.decompress(b, n, asbytes=True) if n else b"")


def codec(name: str) -> tuple[Callable[[bytes], bytes], Callable[[bytes, int], bytes]]:
    """(compress, decompress); decompress takes the size of what it gives."""
    if name not in CODECS:
        raise ValueError(f"unknown codec {name!r}")
    if name == "none":
        return (lambda b: b), (lambda b, n: b)
    gzip = (lambda b: zlib.compress(b, 6, 31)), (lambda b, n: zlib.decompress(b, 31))
    return gzip if name == "gzip" else _arrow(name) or gzip


def benchmark(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each row's bytes as they are and under each codec, and whether all came back the same."""
    names = [c for c in CODECS if c != "none"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [codec(n) for n in names]
        for batch in batches:
            raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
            sizes: list[list[int]] = [[] for _ in names]
            same = []
            for b in raw:
                ok = True
                for (put, get), column in zip(pairs, sizes, strict=True):
                    packed = put(b)
                    column.append(len(packed))
                    ok = ok and get(packed, len(b)) == b
                same.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in raw], pa.int64()), *(pa.array(c, pa.int64()) for c in sizes), pa.array(same)], [key, "none", *names, "same"])

    return rows.select(key, value).mapInArrow(run, f"{key} long, none long, {', '.join(f'{n} long' for n in names)}, same boolean")
