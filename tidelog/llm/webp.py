"""Lossless WebP (VP8L): a decoder of the whole format, and a writer.

The decoder reads prefix codes (simple and normal, grouped by an entropy image), back-references,
the colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms.
Images are arrays of uint32 pixels, 0xAARRGGBB. Where each code has one length and there is no cache,
the pixels between two back-references are decoded at once, a block at a time; other images are
decoded symbol by symbol.

The writer uses codes of one length, back-references for what comes again, and of the transforms
that one, or none, which gives the fewest bits: palette, predictor (from the left or from above) or
subtract-green.
"""

from __future__ import annotations

import functools

import numpy as np

from tidelog.llm import textbuf

# Fixed values of the format.
MAGIC, VERSION_BITS, SIZE_BITS = 0x2F, 3, 14
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTHS, DISTANCES, CACHE_FACTOR = 24, 40, 0x1E35A7BD
BLACK = 0xFF000000
#: Pixels that are worked on at once; of a window whose hash may start a back-reference; least and most of a back-reference.
BLOCK, WINDOW, LEAST, MOST = 1 << 16, 8, 16, 4096
#: Pixels by which a transform that can't pay is told.
SOME = 256
#: The near places that distance codes 1 to 120 stand for, nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class Bits:
    """Reads bits from the low end of each byte up."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def peek(self) -> int:
        start = self.at >> 3
        return int.from_bytes(self.data[start : start + 5], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        got = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > self.size:
            raise ValueError("the image is cut off")
        return got


class Code:
    """A canonical prefix code; `flat` is the common length of its codes, or None."""

    def __init__(self, lengths: list[int]) -> None:
        used = [(n, s) for s, n in enumerate(lengths) if n]
        if not used:
            used = [(0, 0)]
        self.bits = 0 if len(used) == 1 else max(n for n, _ in used)
        self.symbols = [s for _, s in sorted(used)]
        if len(used) > 1 and sum(1 << (self.bits - n) for n, _ in used) != 1 << self.bits:
            raise ValueError("a prefix code is not complete")
        self.flat = self.bits if len(used) == 1 << self.bits else None
        self.table: list[tuple[int, int]] | None = None
        self._used = used

    def read(self, bits: Bits) -> int:
        if not self.bits:
            return self.symbols[0]
        if self.table is None:
            self.table = self._fill()
        symbol, n = self.table[bits.peek() & ((1 << self.bits) - 1)]
        bits.at += n
        return symbol

    def _fill(self) -> list[tuple[int, int]]:
        if not self.bits:
            return [(self.symbols[0], 0)]
        table = [(0, 0)] * (1 << self.bits)
        code, before = 0, 0
        for n, s in sorted(self._used):
            code <<= n - before
            before = n
            first = int(f"{code:0{n}b}"[::-1], 2)
            for i in range(first, len(table), 1 << n):
                table[i] = (s, n)
            code += 1
        return table


def _read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):  # one or two symbols
        two, wide = bits.read(1), bits.read(1)
        for n in [8 if wide else 1, *[8] * two]:
            symbol = bits.read(n)
            if symbol >= size:
                raise ValueError("a symbol is out of range")
            lengths[symbol] = 1
        return Code(lengths)
    first = [0] * 19
    for i in range(4 + bits.read(4)):
        first[CODE_ORDER[i]] = bits.read(3)
    inner = Code(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    table = inner.table = inner.table or inner._fill()
    mask, data, where = (1 << inner.bits) - 1, bits.data, bits.at
    at, last = 0, 8
    while at < size and left:
        left -= 1
        # A code and its extra bits are 14 bits at most.
        start = where >> 3
        window = int.from_bytes(data[start : start + 3], "little") >> (where & 7)
        x, n = table[window & mask]
        where += n
        if x < 16:
            lengths[at] = x
            at += 1
            last = x or last
            continue
        window >>= n
        if x == 16:
            value, n, wide = last, 3 + (window & 3), 2
        elif x == 17:
            value, n, wide = 0, 3 + (window & 7), 3
        else:
            value, n, wide = 0, 11 + (window & 127), 7
        where += wide
        if at + n > size:
            raise ValueError("code lengths run over")
        if value:
            lengths[at : at + n] = [value] * n
        at += n
    bits.at = where
    if where > bits.size:
        raise ValueError("the image is cut off")
    return Code(lengths)


def _amount(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _blocks(size: int, bits: int) -> int:
    return -(-size >> bits)


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, which, block = 1, None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        which = (_read_image(bits, _blocks(width, block), _blocks(height, block), False) >> 8) & 0xFFFF
        groups = int(which.max()) + 1
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    if which is None and not cache_bits and all(c.flat is not None for c in codes[0]):
        return _by_runs(bits, width, width * height, codes[0]).reshape(height, width)
    return _by_symbol(bits, width, height, codes, which, block, cache_bits)


def _by_runs(bits: Bits, width: int, n: int, codes: list[Code]) -> np.ndarray:
    """The pixels up to the next back-reference at once: each takes the same number of bits."""
    widths = [c.bits for c in codes[:4]]
    per = sum(widths)
    symbols = [np.array(c.symbols, np.uint32) for c in codes[:4]]
    low = np.cumsum([0, *widths]).tolist()
    out, at, step = np.zeros(n, np.uint32), 0, 512
    raw = np.frombuffer(bits.data, np.uint8)

    def column(table: np.ndarray, i: int) -> np.ndarray:
        if not widths[i]:
            return np.broadcast_to(symbols[i][:1], len(table))
        # The first bit of a code is its highest.
        cells = table[:, low[i] : low[i + 1]]
        if widths[i] <= 8:
            return symbols[i][np.packbits(cells, axis=1).ravel() >> (8 - widths[i])]
        index = np.zeros(len(table), np.uint16)
        for j in range(widths[i]):
            index = (index << np.uint16(1)) | cells[:, j]
        return symbols[i][index]

    while at < n:
        k = min(step, n - at)
        start, stop = bits.at >> 3, -(-(bits.at + k * per) // 8)
        cells = np.unpackbits(raw[start:stop], bitorder="little")[bits.at & 7 :][: k * per]
        if len(cells) < k * per:
            cells = np.pad(cells, (0, k * per - len(cells)))  # what follows the last pixels is not read
        table = cells.reshape(k, per)
        green = column(table, 0)
        other = np.flatnonzero(green >= 256)
        got = int(other[0]) if len(other) else k
        part = table[:got]
        out[at : at + got] = (green[:got] << np.uint32(8)) | (column(part, 1) << np.uint32(16)) | column(part, 2) | (column(part, 3) << np.uint32(24))
        at, bits.at = at + got, bits.at + got * per
        if bits.at > bits.size:
            raise ValueError("the image is cut off")
        step = min(4 * step, BLOCK)
        if got < k:
            length = _amount(bits, codes[0].read(bits) - 256)
            distance = _distance(bits, codes[4], width)
            if distance > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            seen = out[at - distance : min(at, at - distance + length)]
            out[at : at + length] = seen if len(seen) == length else np.resize(seen, length)
            at, step = at + length, 128
    return out


def _distance(bits: Bits, code: Code, width: int) -> int:
    distance = _amount(bits, code.read(bits))
    if distance > len(NEAR):
        return distance - len(NEAR)
    x, y = NEAR[distance - 1]
    return max(1, x + y * width)


def _by_symbol(bits: Bits, width: int, height: int, codes: list[list[Code]], which: np.ndarray | None, block: int, cache_bits: int) -> np.ndarray:
    n = width * height
    out = [0] * n
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift = 32 - cache_bits
    kept = 0  # pixels already in the cache
    at = 0
    while at < n:
        group = codes[0] if which is None else codes[int(which[(at // width) >> block, (at % width) >> block])]
        green = group[0].read(bits)
        if green < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = alpha << 24 | red << 16 | green << 8 | blue
            at += 1
        elif green < 256 + LENGTHS:
            length = _amount(bits, green - 256)
            distance = _distance(bits, group[4], width)
            if distance > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            if distance >= length:
                out[at : at + length] = out[at - distance : at - distance + length]
            else:
                seen = out[at - distance : at]
                out[at : at + length] = (seen * (-(-length // distance)))[:length]
            at += length
        else:
            for p in out[kept:at]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
            kept = at
            out[at] = cache[green - 256 - LENGTHS]
            at += 1
    if bits.at > bits.size:
        raise ValueError("the image is cut off")
    return np.array(out, np.uint32).reshape(height, width)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """Blue, green, red, alpha as the last axis."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _guess(mode: int, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _mean(_mean(left, top_right), top)
    if mode == 6:
        return _mean(left, top_left)
    if mode == 7:
        return _mean(left, top)
    if mode == 8:
        return _mean(top_left, top)
    if mode == 9:
        return _mean(top, top_right)
    if mode == 10:
        return _mean(_mean(left, top_left), _mean(top, top_right))
    if mode == 11:
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        half = _mean(left, top)
        return np.clip(half + np.trunc((half - top_left) / 2).astype(np.int64), 0, 255)
    return np.array([0, 0, 0, 255])


def _undo_predictor(pixels: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    height, width = pixels.shape
    out = _channels(pixels).astype(np.int64)
    out[0, 0] = (out[0, 0] + [0, 0, 0, 255]) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255  # the first row: from the left
    mode = (modes >> 8) & 15
    if (mode == mode[0, 0]).all() and mode[0, 0] in (1, 2):  # one way all over: sums along it
        if mode[0, 0] == 2:
            return (np.cumsum(out, axis=0) & 255).astype(np.uint8).view("<u4")[..., 0]
        first = np.cumsum(out[:, 0], axis=0) & 255
        first[0] = out[0, 0]
        out[1:, 0] = first[1:]
        out[1:] = np.cumsum(out[1:], axis=1)
        return (out & 255).astype(np.uint8).view("<u4")[..., 0]
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = (row[0] + above[0]) & 255
        kinds = mode[y >> block][np.arange(width) >> block]
        if width > 1 and (kinds[1:] == 1).all():
            out[y] = np.cumsum(row, axis=0) & 255
            continue
        if width > 1 and (kinds[1:] == 2).all():
            row[1:] = (row[1:] + above[1:]) & 255
            continue
        for x in range(1, width):
            right = above[x + 1] if x + 1 < width else row[0]
            row[x] = (row[x] + _guess(int(kinds[x]), row[x - 1], above[x], above[x - 1], right)) & 255
    return out.astype(np.uint8).view("<u4")[..., 0]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int8).astype(np.int64)


def _undo_cross_colour(pixels: np.ndarray, factors: np.ndarray, block: int) -> np.ndarray:
    height, width = pixels.shape
    f = _channels(factors)[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block]
    out = _channels(pixels).copy()
    green = _signed(out[..., 1])
    red = (out[..., 2] + ((_signed(f[..., 0]) * green) >> 5)) & 255
    blue = out[..., 0] + ((_signed(f[..., 1]) * green) >> 5)
    out[..., 0] = (blue + ((_signed(f[..., 2]) * _signed(red)) >> 5)) & 255
    out[..., 2] = red
    return out.view("<u4")[..., 0]


def _undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    out = _channels(pixels).copy()
    out[..., 0] += out[..., 1]
    out[..., 2] += out[..., 1]
    return out.view("<u4")[..., 0]


def _bundle(colours: int) -> int:
    """log2 of the indices that share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(pixels: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    pack = _bundle(len(palette))
    green = (pixels >> 8) & 255
    per = 8 >> pack
    index = (green[:, :, None] >> (np.arange(1 << pack) * per)) & ((1 << per) - 1)
    index = index.reshape(pixels.shape[0], -1)[:, :width]
    full = np.zeros(256, np.uint32)  # an index beyond the palette is transparent black
    full[: len(palette)] = palette
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width) of a WebP file or a bare VP8L stream."""
    if data[:4] == b"RIFF":
        at = 12
        while data[at : at + 4] != b"VP8L":
            if at + 8 > len(data):
                raise ValueError("no lossless image in the file")
            at += 8 + (int.from_bytes(data[at + 4 : at + 8], "little") + 1) // 2 * 2
        data = data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")]
    bits = Bits(data)
    if bits.read(8) != MAGIC:
        raise ValueError("not a lossless image")
    width, height = bits.read(SIZE_BITS) + 1, bits.read(SIZE_BITS) + 1
    bits.read(1)
    if bits.read(VERSION_BITS):
        raise ValueError("unknown version")
    undo, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            found = _read_image(bits, _blocks(wide, block), _blocks(height, block), False)
            undo.append((_undo_predictor if kind == PREDICTOR else _undo_cross_colour, (found, block)))
        elif kind == SUBTRACT_GREEN:
            undo.append((_undo_subtract_green, ()))
        else:
            n = bits.read(8) + 1
            steps = _channels(_read_image(bits, n, 1, False))[0]
            palette = np.cumsum(steps, axis=0, dtype=np.uint8).view("<u4")[..., 0]
            undo.append((_undo_palette, (palette, wide)))
            wide = _blocks(wide, _bundle(n))
    pixels = _read_image(bits, wide, height, True)
    for step, more in reversed(undo):
        pixels = step(pixels, *more)
    return pixels


class Writer:
    """Collects bits, low end first; whole bytes are packed as they come."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n >= 512:
            self.parts.append((self.value & ((1 << 512) - 1)).to_bytes(64, "little"))
            self.value, self.n = self.value >> 512, self.n - 512

    def array(self, bits: np.ndarray) -> None:
        if self.n:
            raw = np.frombuffer(self.value.to_bytes(-(-self.n // 8), "little"), np.uint8)
            bits = np.concatenate([np.unpackbits(raw, bitorder="little", count=self.n), bits])
        whole = len(bits) // 8 * 8
        self.parts.append(np.packbits(bits[:whole], bitorder="little").tobytes())
        rest = np.packbits(bits[whole:], bitorder="little").tobytes()
        self.value, self.n = int.from_bytes(rest, "little"), len(bits) - whole

    def bytes(self) -> bytes:
        return b"".join([*self.parts, self.value.to_bytes(-(-self.n // 8), "little")])


def _even(used: np.ndarray) -> np.ndarray:
    """Symbols of a code of one length: those used (a flag for each), and unused ones up to a power of two, nearest first."""
    used = used.copy()
    n = int(used.sum())
    size = 1 << (n - 1).bit_length()
    if size > n:
        spare = np.flatnonzero(~used)
        low = np.flatnonzero(used)[0]
        order = np.argsort((spare - low) % len(used), kind="stable")
        used[spare[order[: size - n]]] = True
    return np.flatnonzero(used)


def _prefix(amount: int) -> tuple[int, int, int]:
    """The prefix of a length or distance, its extra bits and their number."""
    amount -= 1
    if amount < 4:
        return amount, 0, 0
    high = amount.bit_length() - 1
    extra = high - 1
    return 2 * high + (amount >> extra & 1), amount & ((1 << extra) - 1), extra


_ODD = textbuf.mix(np.arange(1, WINDOW // 2 + 1, dtype=np.uint64)) | np.uint64(1)


def references(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of what comes again, in order and apart from each other.

    Windows are chosen by their content, an eighth of them; a chosen one that was there before is extended both ways.
    """
    n = len(pixels)
    if n < 2 * LEAST:
        return []
    two = pixels[:-1].astype(np.uint64) | (pixels[1:].astype(np.uint64) << np.uint64(32))
    m = n - WINDOW + 1
    with np.errstate(over="ignore"):
        key = sum(two[i : i + m] * _ODD[i // 2] for i in range(0, WINDOW, 2))
        key ^= key >> np.uint64(29)
    at = np.flatnonzero((key & np.uint64(7)) == 0)
    order = np.argsort(key[at], kind="stable")
    same = np.flatnonzero(key[at][order][1:] == key[at][order][:-1])
    here, there = at[order[same + 1]], at[order[same]]
    by = np.argsort(here)
    here, there = here[by], there[by]
    out: list[tuple[int, int, int]] = []
    done, i = 0, 0
    while i < len(here):
        a, distance = int(here[i]), int(here[i] - there[i])
        if distance > (1 << 20) - len(NEAR):
            i += 1
            continue
        back = 0
        while a - back > done and a - back - distance > 0 and pixels[a - back - 1] == pixels[a - back - 1 - distance]:
            back += 1
        a -= back
        length, step = 0, 64
        while a + length < n:
            b = min(n, a + length + step)
            differ = np.flatnonzero(pixels[a + length : b] != pixels[a + length - distance : b - distance])
            if len(differ):
                length += int(differ[0])
                break
            length, step = b - a, min(4 * step, BLOCK)
        if length >= LEAST:
            for cut in range(0, length, MOST):
                if min(MOST, length - cut) >= LEAST:
                    out.append((a + cut, min(MOST, length - cut), distance))
                    done = a + cut + min(MOST, length - cut)
            i = int(np.searchsorted(here, done))
        else:
            i += 1
    return out


def _put_even_code(out: Writer, symbols: np.ndarray, size: int) -> None:
    out.put(*_even_code(symbols.astype(np.uint16).tobytes(), size))


@functools.lru_cache(1024)
def _even_code(listed: bytes, size: int) -> tuple[int, int]:
    """How a code of one length is written, as a number and its bits."""
    symbols = np.frombuffer(listed, np.uint16)
    if len(symbols) <= 2 and symbols[-1] < 256:
        value, n = 1 | (len(symbols) - 1) << 1 | 1 << 2, 3
        for s in symbols.tolist():
            value |= s << n
            n += 8
        return value, n
    bits = len(symbols).bit_length() - 1
    # Stretches of symbols that have a code: first and last.
    cut = np.flatnonzero(np.diff(symbols.astype(np.int32)) != 1)
    firsts = symbols[np.append(0, cut + 1)].tolist()
    lasts = symbols[np.append(cut, len(symbols) - 1)].tolist()
    tokens: list[tuple[int, int, int]] = []  # symbol, extra bits and their number
    at = 0
    for first, last in zip(firsts, lasts, strict=True):
        run = first - at
        while run >= 11:
            n = min(run, 138)
            tokens.append((18, n - 11, 7))
            run -= n
        if run >= 3:
            tokens.append((17, run - 3, 3))
            run = 0
        tokens += [(0, 0, 0)] * run
        tokens.append((bits, 0, 0))
        run = last - first
        while run >= 3:
            n = min(run, 6)
            tokens.append((16, n - 3, 2))
            run -= n
        tokens += [(bits, 0, 0)] * run
        at = last + 1
    if len(tokens) == 1:  # at least two are written
        tokens.append((0, 0, 0))
    kinds = sorted({t[0] for t in tokens})
    inner = dict.fromkeys(kinds, max(1, (len(kinds) - 1).bit_length()))
    short = (1 << inner[kinds[0]]) - len(kinds)  # so many of them get a code one bit shorter
    if len(kinds) > 1:
        for s in kinds[:short]:
            inner[s] -= 1
    code, before, codes = 0, 0, {}
    for n, s in sorted((n, s) for s, n in inner.items()):
        code <<= n - before
        before = n
        codes[s] = (int(f"{code:0{n}b}"[::-1], 2), n) if len(kinds) > 1 else (0, 0)
        code += 1
    count = max(4, max(CODE_ORDER.index(s) for s in kinds) + 1)
    value, n = (count - 4) << 1, 5
    for s in CODE_ORDER[:count]:
        value |= inner.get(s, 0) << n
        n += 3
    wide = 2 + 2 * max(0, ((len(tokens) - 2).bit_length() - 1) // 2)
    value |= (1 | (wide - 2) // 2 << 1 | (len(tokens) - 2) << 4) << n  # as many tokens as follow
    n += 4 + wide
    for s, extra, more in tokens:
        c, m = codes[s]
        value |= (c | extra << m) << n
        n += m + more
    return value, n


def _codes(used: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
    """The symbols of each code, and the bits of one."""
    symbols = [_even(u) for u in used]
    return symbols, [len(s).bit_length() - 1 for s in symbols]


_PLACE = np.arange(4, dtype=np.uint16) * np.uint16(256)


def _used(pixels: np.ndarray) -> list[np.ndarray]:
    """Which values green, red, blue and alpha have."""
    channels = _channels(pixels.ravel())
    seen = np.bincount((channels + _PLACE).ravel(), minlength=1024).reshape(4, 256) > 0
    return [seen[i] for i in (1, 2, 0, 3)]


@functools.lru_cache(64)
def _near(width: int) -> dict[int, int]:
    """The least code of each distance that has one of a near place."""
    near: dict[int, int] = {}
    for i, (x, y) in enumerate(NEAR):
        near.setdefault(max(1, x + y * width), i + 1)
    return near


def _put_image(out: Writer, pixels: np.ndarray, main: bool) -> None:
    """An image without cache and groups, each channel in a code of one length; the main one with back-references."""
    height, width = pixels.shape
    flat = pixels.ravel()
    found = references(flat) if main else []
    kinds = {_prefix(length)[0] for _, length, _ in found}
    if int(_used(flat)[0].sum()) + len(kinds) > 256:  # a code of one length has 256 symbols at most here
        found = []
    literal = np.ones(len(flat), bool)
    for a, length, _ in found:
        literal[a : a + length] = False
    near = _near(width) if found else {}
    steps = [(a, length, _prefix(length), _prefix(near.get(distance, distance + len(NEAR)))) for a, length, distance in found]
    used = _used(flat[literal])
    used[0] = np.pad(used[0], (0, LENGTHS))
    used.append(np.zeros(DISTANCES, bool))
    used[4][0] = not steps
    for _, _, length, distance in steps:
        used[0][256 + length[0]] = used[4][distance[0]] = True
    out.put(0, 1)
    if main:
        out.put(0, 1)
    symbols, bits = _codes(used)
    for s, size in zip(symbols, (256 + LENGTHS, 256, 256, 256, DISTANCES), strict=True):
        _put_even_code(out, s, size)
    index = []
    for s, size in zip(symbols, (256 + LENGTHS, 256, 256, 256, DISTANCES), strict=True):
        at = np.zeros(size, np.uint16)
        at[s] = np.arange(len(s))
        index.append(at)

    # The highest bit of a code comes first.
    left = [(at << np.uint16(max(0, 8 - n))).astype(np.uint8) for at, n in zip(index[:4], bits, strict=False)]

    def put_pixels(a: int, b: int) -> None:
        for c in range(a, b, BLOCK):
            channels = _channels(flat[c : min(b, c + BLOCK)])
            columns = []
            for i, (place, n) in enumerate(zip((1, 2, 0, 3), bits[:4], strict=True)):
                if 0 < n <= 8:
                    columns.append(np.unpackbits(left[i][channels[:, place]][:, None], axis=1, count=n))
                elif n:
                    value = index[i][channels[:, place]]
                    columns.append(np.column_stack([((value >> np.uint16(j)) & np.uint16(1)).astype(np.uint8) for j in range(n - 1, -1, -1)]))
            if columns:
                out.array(np.concatenate(columns, axis=1).ravel())

    def put_symbol(i: int, symbol: int, extra: int, n: int) -> None:
        code = int(index[i][symbol])
        for j in range(bits[i] - 1, -1, -1):
            out.put(code >> j & 1, 1)
        out.put(extra, n)

    at = 0
    for a, n, length, distance in steps:
        put_pixels(at, a)
        put_symbol(0, 256 + length[0], *length[1:])
        put_symbol(4, distance[0], *distance[1:])
        at = a + n
    put_pixels(at, len(flat))


def _predicted(pixels: np.ndarray, mode: int) -> np.ndarray:
    """What is left of each pixel when the one to the left (1) or above (2) has been taken off."""
    c = _channels(pixels).astype(np.int16)
    out = c.copy()
    out[0, 0] -= np.array([0, 0, 0, 255], np.int16)
    out[0, 1:] -= c[0, :-1]
    out[1:, 0] -= c[:-1, 0]
    out[1:, 1:] -= c[1:, :-1] if mode == 1 else c[:-1, 1:]
    return (out & 255).astype(np.uint8).view("<u4")[..., 0]


def _without_green(pixels: np.ndarray) -> np.ndarray:
    out = _channels(pixels).copy()
    out[..., 0] -= out[..., 1]
    out[..., 2] -= out[..., 1]
    return out.view("<u4")[..., 0]


def _least_bits(pixels: np.ndarray) -> list[int]:
    """What a pixel needs at least without green, and predicted from the left and from above: by SOME evenly spread ones."""
    flat, width = pixels.ravel(), pixels.shape[1]
    at = width + 1 + np.arange(SOME) * max(0, len(flat) - width - 1) // SOME
    at = at[(at < len(flat)) & (at % width > 0)]
    c = [_channels(flat[x]) for x in (at, at - 1, at - width)]
    made = [_without_green(flat[at]), *((c[0] - other).view("<u4")[..., 0] for other in c[1:])]
    return [_bits_of(m) // max(1, m.size) for m in made]


def _bits_of(pixels: np.ndarray) -> int:
    return pixels.size * sum((max(1, int(u.sum())) - 1).bit_length() for u in _used(pixels))


def encode(pixels: np.ndarray) -> bytes:
    """A WebP file of an image."""
    height, width = pixels.shape
    out = Writer()
    out.put(MAGIC, 8)
    out.put(width - 1, SIZE_BITS)
    out.put(height - 1, SIZE_BITS)
    out.put(1, 1)
    out.put(0, VERSION_BITS)
    palette = np.unique(pixels)
    if len(palette) <= 256 and 2 * len(palette) <= pixels.size:
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(palette) - 1, 8)
        steps = np.diff(_channels(palette), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
        _put_image(out, steps.view("<u4").reshape(1, -1), False)
        index = np.searchsorted(palette, pixels).astype(np.uint32)
        pack = _bundle(len(palette))
        per, wide = 8 >> pack, _blocks(width, pack)
        index = np.pad(index, ((0, 0), (0, (wide << pack) - width))).reshape(height, wide, 1 << pack)
        pixels = ((index << (np.arange(1 << pack, dtype=np.uint32) * np.uint32(per))).sum(2).astype(np.uint32) << 8) | np.uint32(BLACK)
    else:
        # A transform pays if its image needs fewer bits by more than it costs to say so.
        best, kind, mode = _bits_of(pixels) - 256, None, 0
        for (k, m), least in zip(((SUBTRACT_GREEN, 0), (PREDICTOR, 1), (PREDICTOR, 2)), _least_bits(pixels), strict=True):
            # The values that some pixels take are no more than all take: what they need already, the image needs.
            if least * pixels.size >= best:
                continue
            made = _without_green(pixels) if k == SUBTRACT_GREEN else _predicted(pixels, m)
            if (size := _bits_of(made)) < best:
                best, kind, mode, chosen = size, k, m, made
        if kind is not None:
            out.put(1, 1)
            out.put(kind, 2)
            if kind == PREDICTOR:
                out.put(7, 3)  # blocks of 512 pixels a side, all of one way
                ways = np.full((_blocks(height, 9), _blocks(width, 9)), BLACK | mode << 8, np.uint32)
                _put_image(out, ways, False)
            pixels = chosen
    out.put(0, 1)
    _put_image(out, pixels, True)
    body = out.bytes()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk
