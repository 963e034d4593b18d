"""Lossless WebP: a decoder for whole batches of images, and an encoder of payloads as images.

Decoding reads a file's container, transforms and prefix codes, then its pixels: literals, back-references and colour
cache entries. The pixels of all images of a batch are decoded in step, one pixel of each image at a time, as numpy
columns over the images; prefix codes are looked up in tables. Then the transforms are undone: palette, subtracted
green, cross-colour, predictor. Images with sub-images (block-wise transforms, several groups of prefix codes) go the
same way, sub-images first. Damaged files raise ValueError.

The encoder lays bytes out as RGBA pixels, ``WIDTH`` a row, at most ``ROWS`` rows a file (a longer payload takes several
files). Each image is written the way that takes the fewest bits: as it is, with back-references of any distance, with a
colour cache, after a transform (subtracted green, cross-colour, predictor), or by a palette whose indices share bytes. Each
way but the last has one set of prefix codes counted over the whole corpus, so that equal payloads give equal files
wherever they are. The codes of all images of a batch are packed at once.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from .common import mix, ragged

WIDTH, ROWS = 144, 64  # 144 pixels of four bytes: the 576 bytes that payloads are padded to
LONGEST_CODE, LONGEST_COPY, RUN = 12, 4096, 4
# Fixed values of the format: order in which lengths of code length codes are stored; pixels meant by the first 120 distances.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40


class Bits:
    """Reads a byte string's bits, the lowest of each byte first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        a = self.at
        if a + n > 8 * len(self.data):
            raise ValueError("file ends early")
        self.at += n
        return int.from_bytes(self.data[a >> 3:(a + n + 7) >> 3], "little") >> (a & 7) & ((1 << n) - 1)


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical code of each symbol, its first bit lowest, as the format stores it."""
    code, out = 0, np.zeros(len(lengths), np.int64)
    for n in range(1, int(lengths.max(initial=0)) + 1):
        for s in np.flatnonzero(lengths == n):
            out[s] = int(format(code, f"0{n}b")[::-1], 2)
            code += 1
        code <<= 1
    return out


class Code:
    """A prefix code as a table over the next ``width`` bits: symbol in the low 16 bits, length above."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:  # one symbol takes no bits
            self.width, self.table = 0, np.array([used[0] if len(used) else 0], np.int32)
            return
        total = sum(1 << (15 - int(n)) for n in lengths[used])
        if total != 1 << 15:
            raise ValueError("prefix code is not complete")
        self.width = int(lengths.max())
        self.table = np.zeros(1 << self.width, np.int32)
        for s, c in zip(used, reversed_codes(lengths)[used]):
            self.table[c::1 << int(lengths[s])] = s | int(lengths[s]) << 16

    def read(self, bits: Bits) -> int:
        a, have = bits.at, 8 * len(bits.data) - bits.at
        e = int(self.table[int.from_bytes(bits.data[a >> 3:(a >> 3) + 3], "little") >> (a & 7) & ((1 << self.width) - 1)])
        if e >> 16 > have:
            raise ValueError("file ends early")
        bits.at += e >> 16
        return e & 0xFFFF


def read_code(bits: Bits, symbols: int) -> Code:
    lengths = np.zeros(max(symbols, LITERALS), np.int64)
    if bits.take(1):
        two = bits.take(1)
        lengths[bits.take(8 if bits.take(1) else 1)] = 1
        if two:
            lengths[bits.take(8)] = 1
        return Code(lengths[:symbols] if symbols < LITERALS and not lengths[symbols:].any() else lengths)
    first = np.zeros(19, np.int64)
    for i in range(4 + bits.take(4)):
        first[LENGTH_ORDER[i]] = bits.take(3)
    code, left = Code(first), symbols
    if bits.take(1):
        left = 2 + bits.take(2 + 2 * bits.take(3))
        if left > symbols:
            raise ValueError("too many code lengths")
    at, before = 0, 8
    while at < symbols and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            before, at = s or before, at + 1
            continue
        n = {16: lambda: 3 + bits.take(2), 17: lambda: 3 + bits.take(3), 18: lambda: 11 + bits.take(7)}[s]()
        if at + n > symbols:
            raise ValueError("code lengths run over")
        lengths[at:at + n] = before if s == 16 else 0
        at += n
    return Code(lengths[:symbols])


@dataclass
class Plan:
    """What is needed to decode the pixels of one image or sub-image, from bit ``at`` of its data on."""

    data: bytes
    at: int
    width: int
    height: int
    groups: list[list[Code]]
    cache_bits: int = 0
    block_bits: int = 0
    block_map: np.ndarray | None = None  # group of each block
    transforms: list[tuple] = field(default_factory=list)
    full_width: int = 0


def _blocks(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


def _codes(bits: Bits, width: int, height: int, main: bool) -> Plan:
    cache = bits.take(4) if bits.take(1) else 0
    if cache > 11:
        raise ValueError("colour cache too large")
    plan = Plan(bits.data, 0, width, height, [], cache)
    n = 1
    if main and bits.take(1):
        plan.block_bits = bits.take(3) + 2
        plan.block_map = _sub_image(bits, _blocks(width, plan.block_bits), _blocks(height, plan.block_bits)) >> 8 & 0xFFFF
        n = int(plan.block_map.max()) + 1
    sizes = (LITERALS + LENGTHS + (1 << cache if cache else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
    plan.groups = [[read_code(bits, s) for s in sizes] for _ in range(n)]
    plan.at = bits.at
    return plan


def _sub_image(bits: Bits, width: int, height: int) -> np.ndarray:
    pixels, ends = decode_pixels([_codes(bits, width, height, False)])
    bits.at = ends[0]
    return pixels[0].astype(np.int64)


def container(raw: bytes) -> bytes:
    """The image data of a file."""
    if len(raw) < 20 or raw[:4] != b"RIFF" or raw[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(raw):
        kind, size = raw[at:at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if kind == b"VP8L":
            if at + 8 + size > len(raw) or size < 5 or raw[at + 8] != 0x2F:
                raise ValueError("damaged VP8L chunk")
            return raw[at + 8:at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


class Headers:
    """Reads image headers; transforms and codes of a header without a palette or groups are kept and met again by comparing bytes."""

    def __init__(self, kept: int = 8):
        self.kept, self.known = kept, []

    def plan(self, raw: bytes) -> Plan:
        data = container(raw)
        bits = Bits(data, 8)
        width, height = bits.take(14) + 1, bits.take(14) + 1
        bits.take(1)
        if bits.take(3):
            raise ValueError("unknown version")
        for head, n, plan in self.known:
            # sub-images of transforms are as large as the image asks for
            if plan.transforms and (width != plan.full_width or any(_blocks(height, t[2]) != _blocks(plan.height, t[2]) for t in plan.transforms if len(t) > 2)):
                continue
            if data.startswith(head, 5) and not (n & 7 and (data[5 + len(head)] ^ plan.data[5 + len(head)]) & ((1 << (n & 7)) - 1)):
                return Plan(data, 40 + n, width, height, plan.groups, plan.cache_bits, transforms=plan.transforms, full_width=width)
        transforms, x = [], width
        while bits.take(1):
            kind = bits.take(2)
            if any(t[0] == kind for t in transforms):
                raise ValueError("a transform twice")
            if kind in (PREDICTOR, CROSS_COLOUR):
                b = bits.take(3) + 2
                transforms.append((kind, x, b, _sub_image(bits, _blocks(x, b), _blocks(height, b))))
            elif kind == PALETTE:
                n = bits.take(8) + 1
                table = _sub_image(bits, n, 1).astype(np.uint32).view(np.uint8).reshape(-1, 4)
                table = np.cumsum(table, axis=0, dtype=np.uint8).copy().view(np.uint32).reshape(-1)
                pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                transforms.append((kind, x, pack, table))
                x = _blocks(x, pack)
            else:
                transforms.append((kind, x))
        plan = _codes(bits, x, height, True)
        plan.transforms, plan.full_width = transforms, width
        if all(t[0] != PALETTE for t in transforms) and plan.block_map is None:
            n = plan.at - 40
            self.known = [(data[5:5 + (n >> 3)], n, plan), *self.known][:self.kept]
        return plan


def decode_pixels(plans: Sequence[Plan]) -> tuple[list[np.ndarray], list[int]]:
    """The coded pixels of each image (before transforms are undone), and the bit where each ends."""
    order = np.argsort([-p.width * p.height for p in plans], kind="stable")
    plans = [plans[i] for i in order]
    # all data in one array of 32-bit words, each image padded so that reading ahead stays in it
    room = [(len(p.data) + 19) // 4 for p in plans]
    base = np.concatenate(([0], np.cumsum(room))).astype(np.int64)
    raw = b"".join(p.data + bytes(4 * r - len(p.data)) for p, r in zip(plans, room))
    buf = np.frombuffer(raw, "<u4").astype(np.uint64)
    pos = base[:-1] * 32 + np.array([p.at for p in plans], np.int64)
    limit = base[:-1] * 32 + np.array([8 * len(p.data) for p in plans], np.int64)
    n_px = np.array([p.width * p.height for p in plans], np.int64)
    first = np.concatenate(([0], np.cumsum(n_px)))
    out = np.zeros(int(first[-1]), np.uint32)
    # tables of all different groups; per image the place and mask of each of its five codes
    tables, where, place, mask = [], {}, [], []
    at = 0
    group_of = np.zeros(len(plans), np.int64)
    for k, p in enumerate(plans):
        key = id(p.groups)
        if key not in where:
            where[key] = len(place)
            for g in p.groups:
                row = []
                for c in g:
                    row.append(at)
                    tables.append(c.table)
                    at += len(c.table)
                place.append(row)
                mask.append([(1 << c.width) - 1 for c in g])
        group_of[k] = where[key]
    table = np.concatenate(tables)
    place, mask = np.array(place, np.int64).T.copy(), np.array(mask, np.uint64).T.copy()
    width = np.array([p.width for p in plans], np.int64)
    blocked = np.array([p.block_map is not None for p in plans])
    cache_bits = np.array([p.cache_bits for p in plans], np.int64)
    cache_at = np.concatenate(([0], np.cumsum(np.where(cache_bits > 0, 1 << cache_bits, 0))))
    cache = np.zeros(int(cache_at[-1]), np.uint32)
    maps = [p.block_map for p in plans if p.block_map is not None]
    map_at = np.concatenate(([0], np.cumsum([len(p.block_map) if p.block_map is not None else 0 for p in plans]))).astype(np.int64)
    block = np.concatenate(maps) if maps else np.zeros(0, np.int64)
    block_bits = np.array([p.block_bits for p in plans], np.int64)
    across = _blocks(width, block_bits)
    code_at, code_mask = place[:, group_of], mask[:, group_of]
    left = np.zeros(len(plans), np.int64)  # pixels of a back-reference still to copy
    back = np.zeros(len(plans), np.int64)
    alive = np.searchsorted(-n_px, -np.arange(int(n_px.max(initial=0))), "left")  # images with more than t pixels
    any_copy, any_cache, any_block = False, bool(len(cache)), bool(len(maps))
    five, low31, u32 = np.int64(5), np.int64(31), np.uint64(32)
    cache_shift = (32 - cache_bits).astype(np.uint64)
    near_x, near_y = np.array(NEAR, np.int64).T

    def look(at: np.ndarray) -> np.ndarray:
        """The next 33 bits or more from each place."""
        i = at >> five
        return (buf[i + 1] << u32 | buf[i]) >> (at & low31).astype(np.uint64)

    def read(window: np.ndarray, k: int, who) -> tuple[np.ndarray, np.ndarray]:
        e = table[code_at[k][who] + (window & code_mask[k][who]).astype(np.int64)]
        return e & 0xFFFF, e >> 16

    def number(prefix: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of a length or distance prefix with its extra bits, and how many these are."""
        extra = np.maximum(prefix - 2, 0) >> 1
        start = np.where(prefix < 4, prefix, 2 + (prefix & 1) << extra)
        return start + (window & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))).astype(np.int64) + 1, extra

    for t in range(len(alive)):
        n = int(alive[t])
        who: slice | np.ndarray = slice(0, n)
        if any_block:
            b = np.flatnonzero(blocked[:n])
            y, x = t // width[b], t % width[b]
            g = group_of[b] + block[map_at[b] + (y >> block_bits[b]) * across[b] + (x >> block_bits[b])]
            code_at[:, b], code_mask[:, b] = place[:, g], mask[:, g]
        if any_copy:
            who = np.flatnonzero(left[:n] == 0)
        p = pos[who]
        window = look(p)
        green, size = read(window, 0, who)
        plain = green < LITERALS
        if plain.all():
            lit, lit_p, lit_w, lit_g, lit_s = who, p, window, green, size
        else:
            me = np.arange(n)[who] if isinstance(who, slice) else who
            lit, lit_p, lit_w, lit_g, lit_s = me[plain], p[plain], window[plain], green[plain], size[plain]
            ref = (green >= LITERALS) & (green < LITERALS + LENGTHS)
            if ref.any():
                i, q, s = me[ref], p[ref] + size[ref], green[ref].astype(np.int64) - LITERALS
                long, extra = number(s, look(q))
                q = q + extra
                w = look(q)
                d, size_d = read(w, 4, i)
                if (d >= DISTANCES).any():
                    raise ValueError("unknown distance")
                d, extra = number(d.astype(np.int64), w >> size_d.astype(np.uint64))
                close = d <= len(NEAR)
                k = np.minimum(d, len(NEAR)) - 1
                d = np.where(close, np.maximum(near_x[k] + near_y[k] * width[i], 1), d - len(NEAR))
                if (d > t).any() or (long > n_px[i] - t).any():
                    raise ValueError("back-reference out of the image")
                pos[i] = q + size_d + extra
                left[i], back[i] = long, d
                any_copy = True
            hit = green >= LITERALS + LENGTHS
            if hit.any():
                i, s = me[hit], green[hit].astype(np.int64) - LITERALS - LENGTHS
                out[first[i] + t] = cache[cache_at[i] + s]
                pos[i] = p[hit] + size[hit]
        if len(lit_p):
            red, size_r = read(lit_w >> lit_s.astype(np.uint64), 1, lit)
            q = lit_p + lit_s + size_r
            w = look(q)
            blue, size_b = read(w, 2, lit)
            alpha, size_a = read(w >> size_b.astype(np.uint64), 3, lit)
            pos[lit] = q + size_b + size_a
            out[first[:-1][lit] + t] = alpha.astype(np.uint32) << np.uint32(24) | red.astype(np.uint32) << np.uint32(16) | lit_g.astype(np.uint32) << np.uint32(8) | blue.astype(np.uint32)
        if any_copy:
            i = np.flatnonzero(left[:n])
            if len(i):
                out[first[i] + t] = out[first[i] + t - back[i]]
                left[i] -= 1
            any_copy = bool(left[:n].any())
        if any_cache:
            i = np.flatnonzero(cache_bits[:n])
            v = out[first[i] + t]
            slot = (v.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> cache_shift[i]
            cache[cache_at[i] + slot.astype(np.int64)] = v
    if (pos > limit).any():
        raise ValueError("file ends early")
    pixels, ends = [None] * len(plans), [0] * len(plans)
    for k, i in enumerate(order.tolist()):
        pixels[i], ends[i] = out[first[k]:first[k + 1]], int(pos[k] - base[k] * 32)
    return pixels, ends


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _select(left: np.ndarray, top: np.ndarray, corner: np.ndarray) -> np.ndarray:
    return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top


def _half(a: np.ndarray, corner: np.ndarray) -> np.ndarray:
    d = a - corner
    return np.clip(a + (d + (d < 0) >> 1), 0, 255)  # halves are rounded to zero


# prediction from left, top, top right and top left pixel, by mode
_MODES = (
    lambda l, t, r, c: np.array([0, 0, 0, 255]), lambda l, t, r, c: l, lambda l, t, r, c: t, lambda l, t, r, c: r, lambda l, t, r, c: c,
    lambda l, t, r, c: _average(_average(l, r), t), lambda l, t, r, c: _average(l, c), lambda l, t, r, c: _average(l, t),
    lambda l, t, r, c: _average(c, t), lambda l, t, r, c: _average(t, r), lambda l, t, r, c: _average(_average(l, c), _average(t, r)),
    lambda l, t, r, c: _select(l, t, c), lambda l, t, r, c: np.clip(l + t - c, 0, 255), lambda l, t, r, c: _half(_average(l, t), c),
    lambda l, t, r, c: np.array([0, 0, 0, 255]), lambda l, t, r, c: np.array([0, 0, 0, 255]),
)
_FROM_LEFT = frozenset((1, 5, 6, 7, 10, 11, 12, 13))


def _unpredict(px: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    """Adds predictions to residuals; px: height x width x (blue, green, red, alpha)."""
    h, w, _ = px.shape
    mode = (modes >> 8 & 15).reshape(_blocks(h, bits), _blocks(w, bits))
    out = px.astype(np.int64)
    out[0, 0, 3] += 255
    out[0] = np.cumsum(out[0], axis=0) & 255  # the first row goes by the left pixel
    for y in range(1, h):
        row, top = out[y], out[y - 1]
        row[0] = (row[0] + top[0]) & 255
        for bx in range(mode.shape[1]):
            x0, x1 = max(1, bx << bits), min(w, (bx + 1) << bits)
            if x0 >= x1:
                continue
            m = int(mode[y >> bits, bx])
            if m in _FROM_LEFT:
                if m == 1:
                    row[x0:x1] = (row[x0 - 1] + np.cumsum(row[x0:x1], axis=0)) & 255
                    continue
                for x in range(x0, x1):
                    row[x] = (row[x] + _MODES[m](row[x - 1], top[x], top[x + 1] if x + 1 < w else row[0], top[x - 1])) & 255
                continue
            # the pixel top right of the last one is the first of this row
            right = np.concatenate((top[x0 + 1:x1 + 1], row[:1])) if x1 == w else top[x0 + 1:x1 + 1]
            row[x0:x1] = (row[x0:x1] + _MODES[m](None, top[x0:x1], right, top[x0 - 1:x1 - 1])) & 255
    return out.astype(np.uint8)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int64)


def _uncross(px: np.ndarray, bits: int, factors: np.ndarray) -> np.ndarray:
    h, w, _ = px.shape
    f = factors.reshape(_blocks(h, bits), _blocks(w, bits))[np.arange(h)[:, None] >> bits, np.arange(w)[None, :] >> bits]
    green = _signed(px[..., 1])
    red = (px[..., 2] + (_signed(f & 255) * green >> 5)) & 255
    blue = (px[..., 0] + (_signed(f >> 8 & 255) * green >> 5) + (_signed(f >> 16 & 255) * _signed(red) >> 5)) & 255
    return np.stack((blue, px[..., 1], red, px[..., 3]), -1).astype(np.uint8)


def undone(pixels: np.ndarray, plan: Plan) -> np.ndarray:
    """The image, height x width x RGBA, all transforms undone."""
    px = np.ascontiguousarray(pixels).view(np.uint8).reshape(plan.height, plan.width, 4)  # blue, green, red, alpha
    for kind, width, *more in reversed(plan.transforms):
        if kind == SUBTRACT_GREEN:
            px = px.copy()
            px[..., 0] += px[..., 1]
            px[..., 2] += px[..., 1]
        elif kind == PALETTE:
            pack, table = more
            x, each = np.arange(width), 8 >> pack
            index = px[:, x >> pack, 1] >> ((x & ((1 << pack) - 1)) * each).astype(np.uint8) & ((1 << each) - 1)
            table = np.concatenate((table, np.zeros(max(0, 256 - len(table)), np.uint32)))
            px = np.ascontiguousarray(table[index], "<u4").view(np.uint8).reshape(plan.height, width, 4)
        elif kind == CROSS_COLOUR:
            px = _uncross(px, *more)
        else:
            px = _unpredict(px, *more)
    return px[..., [2, 1, 0, 3]]


def decode(files: Sequence[bytes]) -> list[np.ndarray]:
    """Pixel arrays, height x width x RGBA, of whole files."""
    if not files:
        return []
    headers = Headers()
    plans = [headers.plan(f) for f in files]
    pixels, _ = decode_pixels(plans)
    return [undone(p, plan) for p, plan in zip(pixels, plans)]


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of a prefix code for symbols with these counts, none above ``longest``."""
    counts = counts.astype(np.int64)
    out = np.zeros(len(counts), np.int64)
    while True:
        heap = [(int(c), s, (s,)) for s, c in enumerate(counts) if c]
        if len(heap) < 2:
            out[[h[1] for h in heap]] = 1
            return out
        heapq.heapify(heap)
        out[:] = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            both = a[2] + b[2]
            out[list(both)] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], both))
        if out.max() <= longest:
            return out
        counts = np.where(counts > 0, counts // 2 + 1, 0)  # flatter counts give shorter codes


def code_header(lengths: np.ndarray) -> list[tuple[int, int]]:
    """(value, bits) that store a prefix code."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < LITERALS):
        s = used.tolist() or [0]
        return [(1, 1), (len(s) - 1, 1), (1, 1), (s[0], 8), *((x, 8) for x in s[1:])]
    tokens, at, before = [], 0, 8
    values = lengths.tolist()
    while at < len(values):
        n = 1
        while at + n < len(values) and values[at + n] == values[at]:
            n += 1
        v = values[at]
        if v == 0 and n >= 3:
            n = min(n, 138)
            tokens.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
        elif v and v == before and n >= 3:
            n = min(n, 6)
            tokens.append((16, n - 3, 2))
        else:
            n, before = 1, v or before
            tokens.append((v, 0, 0))
        at += n
    first = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    codes = reversed_codes(first)
    stored = max(i for i, s in enumerate(LENGTH_ORDER) if first[s]) + 1
    stored = max(stored, 4)
    out = [(0, 1), (stored - 4, 4), *((int(first[s]), 3) for s in LENGTH_ORDER[:stored]), (0, 1)]
    single = np.count_nonzero(first) == 1
    for s, extra, n in tokens:
        out += ([] if single else [(int(codes[s]), int(first[s]))]) + ([(extra, n)] if n else [])
    return out


def _joined(parts: Sequence[tuple[int, int]]) -> tuple[int, int]:
    value = n = 0
    for v, k in parts:
        value, n = value | v << n, n + k
    return value, n


def as_prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits' value and their number, for lengths or distances from 1 on."""
    v = value - 1
    top = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    extra = np.maximum(top - 1, 0)
    prefix = np.where(v < 4, v, 2 * top + (v >> extra & 1))
    extra = np.where(v < 4, 0, extra)
    return prefix, v & ((1 << extra) - 1), extra


# What an image may be written as: as it is, copies being runs of one pixel; copies of any distance; these and a colour cache;
# and these after a transform: green subtracted, blue less red, the difference to the left pixel. PALETTE is a way of its own.
PLAIN, FAR, CACHED, GREEN, CROSS, LEFT = WAYS = range(6)
CACHE_BITS, BUNDLED = 6, 16  # colours of a palette whose indices share bytes, at most
SYMBOLS = LITERALS + LENGTHS + (1 << CACHE_BITS)
_PLACE = np.uint64(28)  # bits of a pixel's place in a batch


def _near_codes(width: int) -> np.ndarray:
    """The distance code of each distance, 0 where it has none of the near ones."""
    d = np.array([max(x + y * width, 1) for x, y in NEAR])
    out = np.zeros(int(d.max()) + 1, np.int64)
    out[d[::-1]] = np.arange(len(NEAR), 0, -1)
    return out


def copies(pixels: np.ndarray, off: np.ndarray, far: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of the stretches of RUN pixels or more that repeat earlier ones of their image: the next pixel
    before or, with far, the last place of the same RUN pixels."""
    back = np.zeros(len(pixels) + 1, np.int64)
    image = np.repeat(np.arange(len(off) - 1), np.diff(off))
    room = np.arange(len(pixels)) + RUN <= off[1:][image]
    if far and room.any():
        at = np.flatnonzero(room)
        h = image[at].astype(np.uint64)
        for j in range(RUN):
            h = mix(h + pixels[at + j])
        key = np.sort(h >> _PLACE << _PLACE | at.astype(np.uint64))
        place = (key & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
        same = np.flatnonzero(key[1:] >> _PLACE == key[:-1] >> _PLACE)
        early, late = place[same], place[same + 1]
        ok = image[early] == image[late]
        for j in range(RUN):
            ok &= pixels[early + j] == pixels[late + j]
        back[late[ok]] = (late - early)[ok]
    elif room.any():
        same = np.zeros(len(pixels) + 1, bool)
        same[1:-1] = pixels[1:] == pixels[:-1]
        same[off[:-1]] = False
        ok = room.copy()
        for j in range(RUN):
            ok[:len(ok) - j] &= same[j:len(pixels)]
        back[:-1][ok] = 1
    # neighbours that repeat at one distance are one stretch; it ends where the next begins
    first = back > 0
    first[1:] &= back[1:] != back[:-1]
    first[off[:-1]] = back[off[:-1]] > 0
    a = np.flatnonzero(first)
    if not len(a):
        return a, a, a
    live = np.flatnonzero(back[:-1])
    end = live[np.searchsorted(live, np.append(a[1:], len(pixels))) - 1] + RUN
    end = np.minimum(end, np.append(a[1:], len(pixels)))
    n = end - a
    a, n = a[n >= RUN], n[n >= RUN]
    parts = -(-n // LONGEST_COPY)
    k = ragged(np.zeros(len(n), np.int64), parts)
    start = np.repeat(a, parts) + k * LONGEST_COPY
    return start, np.minimum(np.repeat(n, parts) - k * LONGEST_COPY, LONGEST_COPY), np.repeat(back[a], parts)


def slots(pixels: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The place in the colour cache where each pixel is found, -1 where it isn't."""
    p = pixels.astype(np.uint64)
    argb = p & np.uint64(0xFF00FF00) | (p & np.uint64(0xFF)) << np.uint64(16) | p >> np.uint64(16) & np.uint64(0xFF)
    slot = (argb * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)
    image = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(off))
    key = np.sort((image << np.uint64(CACHE_BITS) | slot) << _PLACE | np.arange(len(p), dtype=np.uint64))
    place = (key & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    hit = np.flatnonzero((key[1:] >> _PLACE == key[:-1] >> _PLACE) & (pixels[place[1:]] == pixels[place[:-1]])) + 1
    out = np.full(len(p), -1)
    out[place[hit]] = slot[place[hit]]
    return out


def changed(pixels: np.ndarray, off: np.ndarray, way: int, width: int = WIDTH) -> np.ndarray:
    """The pixels after a way's transform."""
    if way not in (GREEN, CROSS, LEFT):
        return pixels
    b = pixels.view(np.uint8).reshape(-1, 4)
    out = b.copy()
    if way == GREEN:
        out[:, [0, 2]] -= b[:, 1:2]
    elif way == CROSS:
        out[:, 2] -= b[:, 0]
    else:
        out[1:] -= b[:-1]
        edge = np.arange(0, len(b), width)  # a row's first pixel goes by the one above, an image's first by opaque black
        out[edge] = b[edge] - b[edge - width]
        out[off[:-1]] = b[off[:-1]] - np.array([0, 0, 0, 255], np.uint8)
    return out.view(np.uint32).reshape(-1)


class Tokens:
    """Literals, copies and cached colours of the pixels of a batch of images that are written one way, in order. found: the
    copies of any distance, if they are known."""

    def __init__(self, pixels: np.ndarray, off: np.ndarray, way: int, width: int = WIDTH, found: tuple | None = None):
        self.way, self.pixels = way, changed(pixels, off, way, width)
        # pixels change one by one but for LEFT, so that equal ones stay equal
        self.copy, n, d = (found or copies(pixels, off, True)) if way not in (PLAIN, LEFT) else copies(self.pixels, off, False)
        cover = np.zeros(len(pixels) + 1, np.int64)
        np.add.at(cover, self.copy, 1)
        np.add.at(cover, self.copy + n, -1)
        single = np.cumsum(cover[:-1]) == 0
        self.prefix, self.extra, self.extra_bits = as_prefix(n)
        near = _near_codes(width)
        code = near[np.minimum(d, len(near) - 1)]
        self.far, self.far_extra, self.far_bits = as_prefix(np.where((d < len(near)) & (code > 0), code, d + len(NEAR)))
        self.cached = self.slot = np.zeros(0, np.int64)
        if way == CACHED and len(pixels):
            slot = slots(pixels, off)
            self.cached = np.flatnonzero(single & (slot >= 0))
            self.slot = slot[self.cached]
            single[self.cached] = False
        self.literal = np.flatnonzero(single)

    def counts(self) -> np.ndarray:
        """How often each symbol of the five codes occurs: 5 x SYMBOLS."""
        out = np.stack([*(np.bincount(c, minlength=SYMBOLS) for c in channels(self.pixels[self.literal])), np.bincount(self.far, minlength=SYMBOLS)])
        out[0] += np.bincount(np.concatenate((LITERALS + self.prefix, LITERALS + LENGTHS + self.slot)).astype(np.int64), minlength=SYMBOLS)
        return out


def channels(pixels: np.ndarray) -> list[np.ndarray]:
    """Green, red, blue and alpha of pixels whose bytes are red, green, blue, alpha: the order of the codes."""
    b = pixels.view(np.uint8).reshape(-1, 4)
    return [b[:, 1], b[:, 0], b[:, 2], b[:, 3]]


def _every_way(pixels: np.ndarray, off: np.ndarray, width: int = WIDTH) -> list[Tokens]:
    found = copies(pixels, off, True)
    return [Tokens(pixels, off, way, width, found) for way in WAYS]


def count_symbols(pixels: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How often each symbol of the five codes occurs if all images are written one way, for each way: 6 x 5 x SYMBOLS."""
    return np.stack([t.counts() for t in _every_way(pixels, off)])


def _one_symbol(s: int) -> list[tuple[int, int]]:
    return [(1, 1), (0, 1), (1, 1), (s, 8)]


def _one_pixel(blue: int = 0, green: int = 0, red: int = 0) -> list[tuple[int, int]]:
    """A sub-image of a single pixel."""
    return [(0, 1), *(x for s in (green, red, blue, 0, 0) for x in _one_symbol(s))]


# a block of 512 x 512 pixels is the whole image; mode 1 predicts from the left; blue less 32 / 32 of red
_TRANSFORM = {GREEN: [(1, 1), (SUBTRACT_GREEN, 2)], CROSS: [(1, 1), (CROSS_COLOUR, 2), (7, 3), *_one_pixel(red=32)], LEFT: [(1, 1), (PREDICTOR, 2), (7, 3), *_one_pixel(green=1)]}


def _file(data: bytes) -> bytes:
    pad = len(data) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(data) + pad) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + b"\0" * pad


def _own_codes(pixels: np.ndarray) -> list[tuple[int, int]]:
    """(value, bits) of pixels as literals with prefix codes of their own; the distance code is unused."""
    out, used = [], []
    for c, size in zip(channels(pixels), (LITERALS + LENGTHS, LITERALS, LITERALS, LITERALS)):
        lengths = code_lengths(np.bincount(c, minlength=size), LONGEST_CODE)
        out += code_header(lengths)
        used.append((reversed_codes(lengths), lengths if np.count_nonzero(lengths) > 1 else lengths * 0))
    out += _one_symbol(0)
    return out + [(int(codes[s]), int(n[s])) for px in zip(*channels(pixels)) for s, (codes, n) in zip(px, used) if n[s]]


def palette_file(pixels: np.ndarray, width: int = WIDTH) -> bytes:
    """The file of an image of at most BUNDLED colours, whose indices share bytes."""
    table, index = np.unique(pixels, return_inverse=True)
    pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1
    colours = table.view(np.uint8).reshape(-1, 4)
    steps = np.diff(colours, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8).view(np.uint32).reshape(-1)
    rows = index.reshape(-1, width)
    rows = np.pad(rows, ((0, 0), (0, -width % (1 << pack)))).reshape(len(rows), -1, 1 << pack)
    bundle = (rows << np.arange(1 << pack) * (8 >> pack)).sum(2).astype(np.uint32).reshape(-1) << np.uint32(8)
    parts = [(0x2F, 8), (width - 1, 14), (len(rows) - 1, 14), (1, 1), (0, 3), (1, 1), (PALETTE, 2), (len(table) - 1, 8), (0, 1), *_own_codes(steps), (0, 1), (0, 1), (0, 1), *_own_codes(bundle)]
    value, n = _joined(parts)
    return _file(value.to_bytes(-(-n // 8), "little"))


class Encoder:
    """Writes files with one set of prefix codes for each way, made from the symbol counts of a corpus; an image is written the way
    that takes the fewest bits."""

    def __init__(self, counts: np.ndarray):
        self.lengths, self.codes, self.head = [], [], []
        symbol = np.arange(SYMBOLS)
        for way in WAYS:
            # any byte, length, slot and distance can be written
            green = counts[way, 0] + (symbol < LITERALS + LENGTHS + (1 << CACHE_BITS if way == CACHED else 0))
            far = counts[way, 4, :DISTANCES] + (symbol[:DISTANCES] == 1 if way in (PLAIN, LEFT) else 1)
            size = SYMBOLS if way == CACHED else LITERALS + LENGTHS
            lengths = [code_lengths(green[:size], LONGEST_CODE), *(code_lengths(c[:LITERALS] + 1, LONGEST_CODE) for c in counts[way, 1:4]), code_lengths(far, LONGEST_CODE)]
            # the transform, the cache, one group of codes
            head = [*_TRANSFORM.get(way, []), (0, 1), *([(1, 1), (CACHE_BITS, 4)] if way == CACHED else [(0, 1)]), (0, 1), *(x for n in lengths for x in code_header(n))]
            self.head.append(_joined(head))
            self.codes.append([reversed_codes(n).astype(np.uint64) for n in lengths])
            self.lengths.append([n if np.count_nonzero(n) > 1 else n * 0 for n in lengths])  # one symbol takes no bits

    def _events(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, value and bits of what is written for the pixels."""
        codes, lengths = self.codes[t.way], [n.astype(np.uint64) for n in self.lengths[t.way]]
        value, bits = np.zeros(len(t.literal), np.uint64), np.zeros(len(t.literal), np.uint64)
        for c, code, n in zip(channels(t.pixels[t.literal]), codes, lengths):
            value |= code[c] << bits
            bits += n[c]
        s = t.prefix + LITERALS
        copy_value, copy_bits = codes[0][s], lengths[0][s].copy()
        for v, n in ((t.extra, t.extra_bits), (codes[4][t.far], lengths[4][t.far]), (t.far_extra, t.far_bits)):
            copy_value = copy_value | v.astype(np.uint64) << copy_bits
            copy_bits += n.astype(np.uint64)
        s = t.slot + LITERALS + LENGTHS if len(t.slot) else t.slot
        return (np.concatenate((t.literal, t.copy, t.cached)), np.concatenate((value, copy_value, codes[0][s] if len(s) else s.astype(np.uint64))),
                np.concatenate((bits, copy_bits, lengths[0][s] if len(s) else s.astype(np.uint64))).astype(np.int64))

    def ways(self, pixels: np.ndarray, off: np.ndarray, width: int = WIDTH) -> np.ndarray:
        """The way of each image that takes the fewest bits."""
        n = len(off) - 1
        image = np.repeat(np.arange(n), np.diff(off))
        cost = np.empty((len(WAYS), n))
        for t in _every_way(pixels, off, width):
            size = self.lengths[t.way]
            bits = np.zeros(len(pixels), np.int64)
            for c, lengths in zip(channels(t.pixels), size):
                bits += lengths[c]
            bits = np.bincount(image[t.literal], bits[t.literal], n)
            bits += np.bincount(image[t.copy], size[0][t.prefix + LITERALS] + t.extra_bits + size[4][t.far] + t.far_bits, n)
            if len(t.cached):
                bits += np.bincount(image[t.cached], size[0][t.slot + LITERALS + LENGTHS], n)
            cost[t.way] = self.head[t.way][1] + bits
        return cost.argmin(0)

    def encode(self, pixels: np.ndarray, off: np.ndarray, width: int = WIDTH) -> list[bytes]:
        """Files of images whose pixels (bytes red, green, blue, alpha) lie one after another; off: n + 1 offsets."""
        n = len(off) - 1
        files: list[bytes] = [b""] * n
        if not n:
            return files
        best = self.ways(pixels, off, width)
        for way in np.unique(best).tolist():
            mine = np.flatnonzero(best == way)
            size = (off[1:] - off[:-1])[mine]
            own = np.concatenate(([0], np.cumsum(size)))
            for i, f in zip(mine.tolist(), self._packed(pixels[ragged(off[:-1][mine], size)], own, way, width)):
                files[i] = f
        image = np.repeat(np.arange(n, dtype=np.uint64), np.diff(off))
        seen = np.sort(image << np.uint64(32) | pixels)
        colours = np.bincount((seen[np.append(True, seen[1:] != seen[:-1])] >> np.uint64(32)).astype(np.int64), minlength=n)
        for i in np.flatnonzero(colours <= BUNDLED).tolist():
            f = palette_file(pixels[off[i]:off[i + 1]], width)
            files[i] = f if len(f) < len(files[i]) else files[i]
        return files

    def _packed(self, pixels: np.ndarray, off: np.ndarray, way: int, width: int) -> list[bytes]:
        """Files of images that are all written one way."""
        events, value, bits = self._events(Tokens(pixels, off, way, width))
        head, head_bits = self.head[way]
        # events of all images in order: the first 40 bits, the codes in pieces of 32 bits, the pixels
        n = len(off) - 1
        height = np.diff(off) // width
        first = np.uint64(0x2F) | np.uint64(width - 1) << np.uint64(8) | (height - 1).astype(np.uint64) << np.uint64(22) | np.uint64(1 << 36)
        pieces = [(head >> i & 0xFFFFFFFF, min(32, head_bits - i)) for i in range(0, head_bits, 32)]
        k = 1 + len(pieces)
        begin = off[:-1]
        place = np.concatenate((np.repeat(begin, k), events))
        rank = np.concatenate((np.tile(np.arange(k), n), np.full(len(events), k)))
        v = np.concatenate((np.column_stack((first, *(np.full(n, p, np.uint64) for p, _ in pieces))).reshape(-1), value))
        b = np.concatenate((np.tile(np.array([40, *(x for _, x in pieces)], np.int64), n), bits))
        order = np.argsort(place * (k + 1) + rank, kind="stable")
        v, b, place = v[order], b[order], place[order]
        # each image starts at a whole 64-bit word
        image = np.searchsorted(begin, place, "right") - 1
        run = np.concatenate(([0], np.cumsum(b)))
        edge = np.searchsorted(image, np.arange(n + 1))
        total = run[edge[1:]] - run[edge[:-1]]
        words = total // 64 + 1
        start = np.concatenate(([0], np.cumsum(words)))
        at = run[:-1] - run[edge[:-1]][image] + start[:-1][image] * 64
        out = np.zeros(int(start[-1]) + 1, np.uint64)
        i, shift = at >> 6, (at & 63).astype(np.uint64)
        cut = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        if len(i):
            out[i[cut]] = np.bitwise_or.reduceat(v << shift, cut)
            over = np.where(shift > 0, v >> np.minimum(np.uint64(64) - shift, np.uint64(63)) >> (shift == 0).astype(np.uint64), np.uint64(0))
            out[i[cut] + 1] |= np.bitwise_or.reduceat(over, cut)
        raw = out.astype("<u8").tobytes()
        return [_file(raw[a:a + size]) for a, size in zip((start[:-1] * 8).tolist(), (-(-total // 8)).tolist())]
