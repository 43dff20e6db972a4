"""A writer of lossless WebP that uses every feature, to test the decoder with."""

import heapq
from itertools import count

import numpy as np

from tidelog.llm import webp


def lengths_of(freq, most):
    """Huffman code lengths of at most `most` bits (frequencies are flattened until they fit)."""
    used = {s: f for s, f in enumerate(freq) if f}
    if len(used) <= 1:
        return [1 if s in used else 0 for s in range(len(freq))]
    while True:
        tie = count()
        heap = [(f, next(tie), [s]) for s, f in used.items()]
        out = dict.fromkeys(used, 0)
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                out[s] += 1
            heapq.heappush(heap, (a[0] + b[0], next(tie), a[2] + b[2]))
        if max(out.values()) <= most:
            return [out.get(s, 0) for s in range(len(freq))]
        used = {s: (f + 1) // 2 for s, f in used.items()}


def codes_of(lengths):
    code, before, out = 0, 0, {}
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    for n, s in used:
        code <<= n - before
        before = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return out


def put_code(out, freq, rng):
    lengths = lengths_of(freq, 15)
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used) and rng.random() < 0.7:
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        wide = used[0] > 1 or rng.random() < 0.5
        out.put(int(wide), 1)
        out.put(used[0], 8 if wide else 1)
        for s in used[1:]:
            out.put(s, 8)
        return codes_of([1 if s in used else 0 for s in range(len(freq))])
    if not used:
        lengths[0] = 1
    tokens, i, last = [], 0, 8
    end = max(s for s, n in enumerate(lengths) if n) + 1
    trim = rng.random() < 0.5
    stop = end if trim else len(lengths)
    while i < stop:
        n = lengths[i]
        run = 1
        while i + run < stop and lengths[i + run] == n:
            run += 1
        if n == 0 and run >= 3:
            run = min(run, 138)
            tokens.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
        elif n and n == last and run >= 3:
            run = min(run, 6)
            tokens.append((16, run - 3, 2))
        else:
            run = 1
            tokens.append((n, 0, 0))
            last = n or last
        i += run
    if trim and len(tokens) < 2:
        tokens.append((0, 0, 0))
    inner_freq = [0] * 19
    for t in tokens:
        inner_freq[t[0]] += 1
    inner = lengths_of(inner_freq, 7)
    inner_codes = codes_of(inner)
    out.put(0, 1)
    out.put(15, 4)
    for s in webp.CODE_ORDER:
        out.put(inner[s], 3)
    out.put(int(trim), 1)
    if trim:
        wide = max(2, (len(tokens) - 2).bit_length())
        wide += wide % 2
        out.put((wide - 2) // 2, 3)
        out.put(len(tokens) - 2, wide)
    for s, extra, n in tokens:
        out.put(*inner_codes[s])
        if n:
            out.put(extra, n)
    return codes_of(lengths)


def prefix(value):
    """(prefix code, extra, bits) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = (v >> (high - 1)) & 1
    extra = high - 1
    return 2 * high + second, v & ((1 << extra) - 1), extra


def put_image(out, pixels, main, rng, refs=True):
    height, width = pixels.shape
    flat = pixels.ravel().tolist()
    cache_bits = int(rng.integers(1, 12)) if rng.random() < 0.5 else 0
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    groups, which, block = 1, None, 0
    if main:
        many = rng.random() < 0.5
        out.put(int(many), 1)
        if many:
            block = int(rng.integers(2, 6))
            groups = int(rng.integers(1, 4))
            which = rng.integers(0, groups, (-(-height >> block), -(-width >> block))).astype(np.uint32)
            which[0, 0] = groups - 1
            out.put(block - 2, 3)
            put_image(out, (which << np.uint32(8)) | np.uint32(webp.BLACK), False, rng)
    near = {(x, y): i + 1 for i, (x, y) in enumerate(webp.NEAR)}
    cache, ops, at, seen = [0] * (1 << cache_bits), [], 0, {}
    while at < len(flat):
        group = 0 if which is None else int(which[(at // width) >> block, (at % width) >> block])
        found = None
        if refs and at and rng.random() < 0.7:
            for distance in [1, width, seen.get(flat[at], at) and at - seen.get(flat[at], at)]:
                if 0 < distance <= at:
                    n = 0
                    while at + n < len(flat) and n < 4096 and flat[at + n] == flat[at + n - distance]:
                        n += 1
                    if n >= 2 and (found is None or n > found[1]):
                        found = (distance, n)
        if found:
            distance, n = found
            code = distance + 120
            for (x, y), i in near.items():
                if max(1, x + y * width) == distance:
                    code = i
                    break
            lp, dp = prefix(n), prefix(code)
            ops.append((group, [(0, 256 + lp[0]), lp[1:], (4, dp[0]), dp[1:]]))
        else:
            n = 1
            p = flat[at]
            slot = (webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            if cache_bits and cache[slot] == p and (at > 0 or p == 0):
                ops.append((group, [(0, 280 + slot)]))
            else:
                ops.append((group, [(0, p >> 8 & 255), (1, p >> 16 & 255), (2, p & 255), (3, p >> 24)]))
        for p in flat[at : at + n]:
            if cache_bits:
                cache[(webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            seen[p] = at
        at += n
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    freq = [[[0] * n for n in sizes] for _ in range(groups)]
    for group, parts in ops:
        symbols = parts if len(parts) != 4 or parts[0][1] < 256 else [parts[0], parts[2]]
        for kind, s in symbols:
            freq[group][kind][s] += 1
    codes = [[put_code(out, f, rng) for f in fs] for fs in freq]
    for group, parts in ops:
        if len(parts) == 4 and parts[0][1] >= 256:
            out.put(*codes[group][0][parts[0][1]])
            out.put(*parts[1])
            out.put(*codes[group][4][parts[2][1]])
            out.put(*parts[3])
        else:
            for kind, s in parts:
                out.put(*codes[group][kind][s])
        if out.n > 4096:
            keep = out.n % 8
            low = out.n - keep
            rest = out.value >> low
            out.value &= (1 << low) - 1
            out.n = low
            out.settle()
            out.value, out.n = rest, keep


def predict(pixels, modes, block):
    """Residuals for given modes, straight from the format's description."""
    height, width = pixels.shape
    px = webp._channels(pixels).astype(int)
    out = np.zeros_like(px)
    for y in range(height):
        for x in range(width):
            if x == 0 and y == 0:
                guess = np.array([0, 0, 0, 255])
            elif y == 0:
                guess = px[y, x - 1]
            elif x == 0:
                guess = px[y - 1, x]
            else:
                left, top, corner = px[y, x - 1], px[y - 1, x], px[y - 1, x - 1]
                right = px[y - 1, x + 1] if x + 1 < width else px[y, 0]
                half = lambda a, b: (a + b) // 2
                m = int(modes[y >> block, x >> block])
                if m == 11:
                    p = left + top - corner
                    guess = left if abs(p - left).sum() < abs(p - top).sum() else top
                elif m == 12:
                    guess = np.clip(left + top - corner, 0, 255)
                elif m == 13:
                    h = half(left, top)
                    guess = np.array([min(255, max(0, a + int((a - b) / 2))) for a, b in zip(h.tolist(), corner.tolist(), strict=True)])
                else:
                    guess = [np.array([0, 0, 0, 255]), left, top, right, corner, half(half(left, right), top), half(left, corner), half(left, top), half(corner, top), half(top, right), half(half(left, corner), half(top, right))][m]
            out[y, x] = (px[y, x] - guess) & 255
    return out.astype(np.uint8).view("<u4")[..., 0]


def encode(pixels, rng, transforms, refs=True):
    height, width = pixels.shape
    out = webp.Writer()
    out.put(webp.MAGIC, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind == webp.SUBTRACT_GREEN:
            c = webp._channels(pixels).copy()
            c[..., 0] -= c[..., 1]
            c[..., 2] -= c[..., 1]
            pixels = c.view("<u4")[..., 0]
        elif kind == webp.PALETTE:
            palette = np.unique(pixels)
            out.put(len(palette) - 1, 8)
            steps = np.diff(webp._channels(palette), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8).view("<u4")
            put_image(out, steps.reshape(1, -1), False, rng)
            pack = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
            index = np.searchsorted(palette, pixels)
            wide = -(-pixels.shape[1] >> pack)
            packed = np.zeros((height, wide), np.uint32)
            for y in range(height):
                for x in range(pixels.shape[1]):
                    packed[y, x >> pack] |= np.uint32(int(index[y, x]) << ((x & ((1 << pack) - 1)) * (8 >> pack)))
            pixels = (packed << np.uint32(8)) | np.uint32(webp.BLACK)
        else:
            block = int(rng.integers(2, 5))
            shape = (-(-height >> block), -(-pixels.shape[1] >> block))
            out.put(block - 2, 3)
            if kind == webp.PREDICTOR:
                modes = rng.integers(0, 14, shape).astype(np.uint32)
                put_image(out, (modes << np.uint32(8)) | np.uint32(webp.BLACK), False, rng)
                pixels = predict(pixels, modes, block)
            else:
                factors = rng.integers(0, 256, (*shape, 4)).astype(np.uint8)
                factors[..., 3] = 255
                put_image(out, factors.view("<u4")[..., 0], False, rng)
                c = webp._channels(pixels).astype(int)
                signed = lambda v: int(v) - 256 if v > 127 else int(v)
                new = c.copy()
                for y in range(height):
                    for x in range(pixels.shape[1]):
                        f = factors[y >> block, x >> block]
                        blue, green, red = c[y, x, :3]
                        g, r = signed(green), signed(red)
                        new[y, x, 2] = (red - ((signed(f[0]) * g) >> 5)) & 255
                        new[y, x, 0] = (blue - ((signed(f[1]) * g) >> 5) - ((signed(f[2]) * r) >> 5)) & 255
                pixels = new.astype(np.uint8).view("<u4")[..., 0]
    out.put(0, 1)
    put_image(out, np.ascontiguousarray(pixels), True, rng, refs)
    return out.bytes()
