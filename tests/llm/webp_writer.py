"""A plain, slow writer of lossless WebP with every feature of the format, to try the decoder on.

It draws pixels itself: the image is what the format's rules make of the stored residuals, computed here pixel by
pixel straight from those rules.
"""

import random
import struct

import numpy as np

from chartline.llm import webp


class Writer:
    def __init__(self):
        self.value = self.n = 0

    def put(self, v, n):
        assert 0 <= v < 1 << n or n == 0
        self.value |= v << self.n
        self.n += n

    def bytes(self):
        return self.value.to_bytes((self.n + 7) // 8, "little")


def prefix(v):
    """Symbol, extra value, extra bits of a length or distance."""
    if v <= 4:
        return v - 1, 0, 0
    v -= 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def put_code(w, counts):
    lengths = webp.code_lengths(np.array(counts), 15)
    for v, n in webp.code_header(lengths):
        w.put(v, n)
    codes = webp.reversed_codes(lengths)
    single = np.count_nonzero(lengths) <= 1
    return lambda s: w.put(0, 0) if single else w.put(int(codes[s]), int(lengths[s]))


def slot(argb, bits):
    return (argb * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - bits)


def put_image(w, px, width, cache=0, copies=False, block_bits=None, main=True, rnd=random):
    """The coded pixels (a list of argb numbers); copies: (distance symbol or plain distance) are looked for at random."""
    tokens, table, i = [], {}, 0
    height = len(px) // width
    groups = 1
    bmap = None
    if block_bits is not None:
        bw, bh = -(-width >> block_bits) if False else (width + (1 << block_bits) - 1) >> block_bits, (height + (1 << block_bits) - 1) >> block_bits
        bmap = [rnd.randrange(3) for _ in range(bw * bh)]
        bmap[-1] = 2
        groups = 3
    while i < len(px):
        best = (0, 0)
        if copies:
            for code in [*range(1, 121), 120 + 5, 120 + width * 2]:
                d = max(1, webp.NEAR[code - 1][0] + webp.NEAR[code - 1][1] * width) if code <= 120 else code - 120
                n = 0
                while d <= i and i + n < len(px) and px[i + n] == px[i + n - d] and n < 4096:
                    n += 1
                best = max(best, (n, -code))
        g = bmap[(i // width >> block_bits) * bw + (i % width >> block_bits)] if bmap else 0
        if best[0] >= 3:
            tokens.append((g, "copy", *best))
            n = best[0]
        elif cache and table.get(slot(px[i], cache)) == px[i]:
            tokens.append((g, "hit", slot(px[i], cache)))
            n = 1
        else:
            tokens.append((g, "pixel", px[i]))
            n = 1
        for p in px[i:i + n]:
            if cache:
                table[slot(p, cache)] = p
        i += n
    w.put(1 if cache else 0, 1)
    if cache:
        w.put(cache, 4)
    if main:
        w.put(1 if bmap else 0, 1)
        if bmap:
            w.put(block_bits - 2, 3)
            put_image(w, [g << 8 | 0xFF000000 for g in bmap], bw, main=False)
    writers = []
    for g in range(groups):
        count = [[0] * (280 + (1 << cache if cache else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * 40]
        for t in tokens:
            if t[0] != g:
                continue
            if t[1] == "pixel":
                for k, v in enumerate((t[2] >> 8 & 255, t[2] >> 16 & 255, t[2] & 255, t[2] >> 24)):
                    count[k][v] += 1
            elif t[1] == "hit":
                count[0][280 + t[2]] += 1
            else:
                count[0][256 + prefix(t[2])[0]] += 1
                count[4][prefix(-t[3])[0]] += 1
        writers.append([put_code(w, c) for c in count])
    for t in tokens:
        code = writers[t[0]]
        if t[1] == "pixel":
            for k, v in enumerate((t[2] >> 8 & 255, t[2] >> 16 & 255, t[2] & 255, t[2] >> 24)):
                code[k](v)
        elif t[1] == "hit":
            code[0](280 + t[2])
        else:
            s, extra, n = prefix(t[2])
            code[0](256 + s)
            w.put(extra, n)
            s, extra, n = prefix(-t[3])
            code[4](s)
            w.put(extra, n)


def split(p):
    return [p & 255, p >> 8 & 255, p >> 16 & 255, p >> 24]


def join(c):
    return c[0] & 255 | (c[1] & 255) << 8 | (c[2] & 255) << 16 | (c[3] & 255) << 24


def predicted(mode, px, i, width):
    l, t, c = split(px[i - 1]), split(px[i - width]), split(px[i - width - 1])
    r = split(px[i - width + 1])
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda v: max(0, min(255, v))
    if mode in (0, 14, 15):
        return [0, 0, 0, 255]
    if mode == 11:
        p = [x + y - z for x, y, z in zip(l, t, c)]
        return l if sum(abs(a - b) for a, b in zip(p, l)) < sum(abs(a - b) for a, b in zip(p, t)) else t
    if mode == 12:
        return [clamp(x + y - z) for x, y, z in zip(l, t, c)]
    if mode == 13:
        return [clamp(a + int((a - z) / 2)) for a, z in zip(avg(l, t), c)]
    return {1: l, 2: t, 3: r, 4: c, 5: avg(avg(l, r), t), 6: avg(l, c), 7: avg(l, t), 8: avg(c, t), 9: avg(t, r), 10: avg(avg(l, c), avg(t, r))}[mode]


def s8(x):
    return x - 256 if x > 127 else x


def picture(rnd, width, height, transforms=(), cache=0, copies=False, block_bits=None, colours=None):
    """A file, and the pixels (rows of RGBA) that it stands for."""
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    steps, x = [], width
    for kind, bits in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        n = ((x + (1 << bits) - 1) >> bits) * ((height + (1 << bits) - 1) >> bits) if bits else 0
        if kind == webp.PREDICTOR:
            sub = [0xFF000000 | rnd.randrange(16) << 8 for _ in range(n)]
        elif kind == webp.CROSS_COLOUR:
            sub = [rnd.getrandbits(24) | 0xFF000000 for _ in range(n)]
        if kind in (webp.PREDICTOR, webp.CROSS_COLOUR):
            w.put(bits - 2, 3)
            put_image(w, sub, (x + (1 << bits) - 1) >> bits, main=False, cache=rnd.choice((0, 3)), rnd=rnd)
            steps.append((kind, x, bits, sub))
        elif kind == webp.PALETTE:
            table = [rnd.getrandbits(32) for _ in range(colours)]
            w.put(colours - 1, 8)
            deltas = [join([a - b for a, b in zip(split(p), split(q))]) for p, q in zip(table, [0, *table])]
            put_image(w, deltas, colours, main=False, rnd=rnd)
            pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
            steps.append((kind, x, pack, table))
            x = (x + (1 << pack) - 1) >> pack
        else:
            steps.append((kind, x))
    w.put(0, 1)
    few = [rnd.getrandbits(32) for _ in range(6)]
    px = []
    while len(px) < x * height:
        px += [rnd.choice(few)] * rnd.choice((1, 1, 2, 9)) if rnd.random() < 0.7 else [rnd.getrandbits(32)]
    px = px[:x * height]
    put_image(w, px, x, cache, copies, block_bits, rnd=rnd)
    data = w.bytes()
    raw = b"RIFF" + struct.pack("<I", 12 + len(data) + len(data) % 2) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    for step in reversed(steps):
        kind, wide = step[:2]
        if kind == webp.SUBTRACT_GREEN:
            px = [join([c[0] + c[1], c[1], c[2] + c[1], c[3]]) for c in map(split, px)]
        elif kind == webp.PALETTE:
            pack, table = step[2:]
            each = 8 >> pack
            out = []
            for y in range(height):
                for xx in range(wide):
                    v = px[y * x + (xx >> pack)] >> 8 & 255
                    v = v >> (xx % (1 << pack)) * each & ((1 << each) - 1)
                    out.append(table[v] if v < len(table) else 0)
            px, x = out, wide
        elif kind == webp.CROSS_COLOUR:
            bits, sub = step[2:]
            bw = (wide + (1 << bits) - 1) >> bits
            out = []
            for i, p in enumerate(px):
                f = split(sub[(i // wide >> bits) * bw + (i % wide >> bits)])
                b, g, r, a = split(p)
                r = r + (s8(f[0]) * s8(g) >> 5) & 255
                b = b + (s8(f[1]) * s8(g) >> 5) + (s8(f[2]) * s8(r) >> 5) & 255
                out.append(join([b, g, r, a]))
            px = out
        else:
            bits, sub = step[2:]
            bw = (wide + (1 << bits) - 1) >> bits
            out = []
            for i, p in enumerate(px):
                if i == 0:
                    q = [0, 0, 0, 255]
                elif i < wide:
                    q = split(out[i - 1])
                elif i % wide == 0:
                    q = split(out[i - wide])
                else:
                    q = predicted(sub[(i // wide >> bits) * bw + (i % wide >> bits)] >> 8 & 15, out, i, wide)
                out.append(join([a + b for a, b in zip(split(p), q)]))
            px = out
    rows = np.array([[c[2], c[1], c[0], c[3]] for c in map(split, px)], np.uint8).reshape(height, width, 4)
    return raw, rows
