"""The WebP decoder against a writer that uses every feature, and payload round trips."""

import numpy as np
import pytest

from tests.llm import webp_writer
from tidelog.llm import media, webp


def picture(rng, height, width, colours=None):
    if colours:
        table = rng.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32)
        rows = table[rng.integers(0, colours, (height, width))]
    else:
        y, x = np.mgrid[:height, :width]
        c = np.stack([x * 3 + y, x + 2 * y, x * y // 4, np.full_like(x, 255)], -1) + rng.integers(0, 4, (height, width, 4))
        rows = (c & 255).astype(np.uint8).view("<u4")[..., 0]
    rows = np.ascontiguousarray(rows)
    if height > 6:
        rows[height // 2 :] = rows[: height - height // 2]
    return rows


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (3,), (2, 0), (0, 1, 2), (3, 0)])
def test_decoder(seed, transforms):
    rng = np.random.default_rng(seed)
    colours = int(rng.choice([1, 2, 3, 4, 9, 16, 40, 256])) if 3 in transforms else None
    image = picture(rng, int(rng.integers(1, 23)), int(rng.integers(1, 31)), colours)
    assert (webp.decode(webp_writer.encode(image, rng, transforms)) == image).all()


def test_all_predictors_and_channels_wrap():
    rng = np.random.default_rng(9)
    image = rng.integers(0, 1 << 32, (40, 37), dtype=np.uint64).astype(np.uint32)
    for _ in range(4):
        assert (webp.decode(webp_writer.encode(image, rng, (0,), refs=False)) == image).all()


def test_damaged_streams_raise():
    raw = media.store(media.padded(b"some text " * 50))
    with pytest.raises(ValueError):
        webp.decode(raw[: len(raw) // 2])
    with pytest.raises(ValueError):
        webp.decode(b"RIFF....WEBPVP8 ")


@pytest.mark.parametrize("raw", [b"", b"a", b"ab" * 100, bytes(range(256)) * 4, "é漢🙂".encode() * 77, b"\0" * 640, b"\xff" * 64, np.random.default_rng(1).bytes(100_000)])
def test_payloads(raw):
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and payload.startswith(raw) and len(payload) >= 64
    assert media.to_payload(webp.decode(media.store(payload)), len(payload)) == payload


def test_pixel_arrays(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "é" * 5000)], "doc_id long, text string")
    stored = media.images(docs).cache()
    got = {r.doc_id: r for r in media.pixel_arrays(stored).collect()}
    assert got[1].width == 16 and got[1].pixels == b"a".ljust(64, b"\0") and got[2].pixels == bytes(64)
    assert got[None].pixels[:10_000] == ("é" * 5000).encode() and got[None].width * got[None].height * 4 == len(got[None].pixels)
    assert media.pixel_arrays(stored.selectExpr("doc_id", "cast(null as binary) as media")).where("pixels is not null").isEmpty()


def test_query_rows(spark):
    import hashlib
    import zlib

    docs = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (1, "a"), (None, "é" * 5000)], "doc_id long, text string").withColumnRenamed("x", "y")
    got = media.round_trip(docs).collect()
    assert len(got) == 5
    for r in got:
        raw = {1: b"a", 2: b"", 3: b"", None: ("é" * 5000).encode()}[r.doc_id]
        payload = media.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({r.media_sha256 for r in got if r.doc_id in (2, 3)}) == 1


@pytest.mark.parametrize("kind", range(6))
def test_the_writer_uses_what_pays(kind, monkeypatch):
    """Images that call for back-references, a predictor, subtract-green and a palette, over several blocks, by both decoders."""
    monkeypatch.setattr(webp, "BLOCK", 100)
    rng = np.random.default_rng(kind)
    width, height = (16, 90) if kind % 2 else (37, 41)
    y, x = np.mgrid[:height, :width]
    noise = rng.integers(0, 1 << 32, (height, width), dtype=np.uint64).astype(np.uint32)
    image = {
        0: np.concatenate([noise.ravel()[:300], noise.ravel()[20:200], noise.ravel()[:300], np.repeat(noise.ravel()[:1], 200)])[: height * width],
        1: (np.stack([x * 2 + 5, x * 2 + 7, 3 * y, np.full_like(x, 255)], -1) & 255).astype(np.uint8).view("<u4")[..., 0],
        2: (np.cumsum(rng.integers(0, 2, (height, width, 4)), axis=0) & 255).astype(np.uint8).view("<u4")[..., 0],
        3: (np.stack([g := rng.integers(0, 256, (height, width)), g, g, rng.integers(0, 3, (height, width))], -1) + [3, 0, 9, 0]).astype(np.uint8).view("<u4")[..., 0],
        4: noise.ravel()[rng.integers(0, 30, height * width)],
        5: np.tile(noise.ravel()[:64], height * width // 64 + 1),
    }[kind]
    image = np.ascontiguousarray(np.resize(image, (height, width)))
    used = []
    for name in ("references", "_undo_predictor", "_undo_subtract_green", "_undo_palette", "_distance"):
        inner = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a, name=name, inner=inner: used.append(name) or inner(*a))
    raw = webp.encode(image)
    assert (webp.decode(raw) == image).all()
    want = {0: "_distance", 1: "_undo_predictor", 2: "_undo_predictor", 3: "_undo_subtract_green", 4: "_undo_palette", 5: "_distance"}[kind]
    assert want in used, used
    monkeypatch.setattr(webp, "_by_runs", lambda bits, width, n, codes: webp._by_symbol(bits, width, n // width, [codes], None, 0, 0).ravel())
    assert (webp.decode(raw) == image).all()


def test_all_values_and_back_references():
    """More symbols than a code of one length may have: the references go."""
    rng = np.random.default_rng(8)
    image = rng.integers(0, 1 << 32, 3000, dtype=np.uint64).astype(np.uint32)
    image = np.concatenate([image, image[:1000]]).reshape(-1, 16)
    assert (webp.decode(webp.encode(image)) == image).all()


def test_references_are_right_and_apart():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 32, 5000, dtype=np.uint64).astype(np.uint32)
    pixels = np.concatenate([base, base[100:4900], base[:20], np.zeros(9000, np.uint32), base[3000:3100]])
    found, done = webp.references(pixels), 0
    for a, length, distance in found:
        assert a >= done and webp.LEAST <= length <= webp.MOST and 0 < distance <= a
        assert all(pixels[a + i] == pixels[a + i - distance] for i in range(length))
        done = a + length
    assert sum(length for _, length, _ in found) > 4800


#: A lossless image of 4 x 3 pixels, made by hand from the format's definition: normal codes, subtract-green, a colour
#: cache of 2 bits and a back-reference (see its bits below).
def test_an_image_written_bit_by_bit():
    out = webp.Writer()
    for value, n in ((webp.MAGIC, 8), (3, 14), (2, 14), (0, 1), (0, 3)):
        out.put(value, n)
    out.put(1, 1)
    out.put(webp.SUBTRACT_GREEN, 2)
    out.put(0, 1)
    out.put(1, 1)
    out.put(2, 4)  # a cache of four colours
    out.put(0, 1)
    # Green: 10, 20, length prefix 258 (three pixels) and cache entry 280 + 1 or so, two bits each, as a normal code.
    key = lambda p: (webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> 30
    one, two = 0xFF000000 | 5 << 16 | 10 << 8 | 7, 0xFF000000 | 5 << 16 | 20 << 8 | 7
    entry = 280 + key(one)
    green = np.array(sorted([10, 20, 258, entry]))
    webp._put_even_code(out, green, 284)
    for symbol in (5, 7, 255):  # red, blue, alpha: one symbol each
        webp._put_even_code(out, np.array([symbol]), 256)
    webp._put_even_code(out, np.array([1]), 40)  # distance 2, which is one to the left
    place = {int(s): i for i, s in enumerate(green)}

    def symbol(s):
        out.put(place[s] >> 1, 1)
        out.put(place[s] & 1, 1)

    for s in (10, 20, entry, 258, entry, 20, 258, 10, 10):
        symbol(s)
    got = webp.decode(out.bytes())
    a, b = one, two
    coded = [a, b, a, a, a, a, a, b, b, b, b, a] if key(one) != key(two) else None
    plain = lambda p: (p & 0xFF00FF00) | ((p >> 16 & 255) + (p >> 8 & 255) & 255) << 16 | ((p & 255) + (p >> 8 & 255) & 255)
    assert got.ravel().tolist() == [plain(p) for p in coded]
