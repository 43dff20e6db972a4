"""Media columns: payloads stored as lossless WebP images and read back as pixel arrays.

A payload's bytes are the samples of an image, four to a pixel in the order red, green, blue,
alpha, ROW pixels to a row (twice as many, and so on, where the image would be too high).

`images` stores texts, `pixel_arrays` decodes stored images (any lossless WebP file) into pixel arrays;
`round_trip` does both and gives digests.

Defined results: a null or empty text is one unit of zero bytes; equal texts have equal stored
bytes, digests and features; repeated rows and rows with a null id each get a row; an empty table gives
no rows; texts beyond 2**26 bytes would still fit, in wider images with zero pixels at the end, which
are cut off again; memory has a text a few times, not each of its bits. A null image has null pixels, and
one that can't be decoded is an error. Columns besides doc_id and text (or media) are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import textbuf, webp
from tidelog.llm.tables import table

UNIT, ROW, HIGHEST = 64, 16, 1 << 14


def padded(raw: bytes) -> bytes:
    """The bytes up to a positive multiple of UNIT."""
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def to_pixels(payload: bytes) -> np.ndarray:
    rgba = np.frombuffer(payload, np.uint8).reshape(-1, 4)
    width = ROW
    while -(-len(rgba) // width) > HIGHEST:
        width *= 2
    bgra = np.zeros((-(-len(rgba) // width) * width, 4), np.uint8)
    bgra[: len(rgba)] = rgba[:, [2, 1, 0, 3]]
    return bgra.view("<u4").reshape(-1, width)


def to_payload(pixels: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]].tobytes()[:size]


def store(payload: bytes) -> bytes:
    """The stored form: a WebP file."""
    return webp.encode(to_pixels(payload))


def feature(pixels: np.ndarray) -> str:
    """Width, height, the mean of each channel in thousandths, and how many pixels differ from the one before."""
    flat = np.ascontiguousarray(pixels, "<u4").ravel()
    sums = flat.view(np.uint8).reshape(-1, 4).sum(0, dtype=np.int64)
    blue, green, red, alpha = (1000 * sums // len(flat)).tolist()
    return f"{pixels.shape[1]}x{pixels.shape[0]} r{red} g{green} b{blue} a{alpha} d{int((flat[1:] != flat[:-1]).sum())}"


def images(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored form of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = textbuf.texts(batch)
            for a, b in textbuf.slices(col):
                data, off = textbuf.view(col, a, b)
                raw, ends = data.tobytes(), off.tolist()
                made = [store(padded(raw[i:j])) for i, j in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(np.diff(off)), pa.array(made, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("text", "doc_id").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pixel_arrays(stored: DataFrame) -> DataFrame:
    """doc_id, width, height and the pixels (4 bytes each: red, green, blue, alpha) of each row's image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # an image at a time: pixels may be much larger than what is stored
                raw = batch.column(1)[i].as_py()
                pixels = None if raw is None else webp.decode(raw)
                row = (None, None, None) if pixels is None else (pixels.shape[1], pixels.shape[0], to_payload(pixels, 4 * pixels.size))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([x], kind) for x, kind in zip(row, (pa.int32(), pa.int32(), pa.binary()), strict=True))], ["doc_id", "width", "height", "pixels"])

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id long, width int, height int, pixels binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id and what comes back from the stored form of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = textbuf.texts(batch)
            for a, b in textbuf.slices(col):
                data, off = textbuf.view(col, a, b)
                raw, ends = data.tobytes(), off.tolist()
                rows = []
                for i, j in zip(ends, ends[1:], strict=False):
                    payload = padded(raw[i:j])
                    media = store(payload)
                    pixels = webp.decode(media)
                    back = to_payload(pixels, len(payload))
                    rows.append((j - i, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels)))
                names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", *names])

    return docs.select("text", "doc_id").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for every document."""
    return round_trip(table(spark, sf_dir, "documents"))
