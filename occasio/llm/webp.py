"""Lossless WebP (VP8L): a decoder for the whole bit stream and an encoder.

The decoder reads prefix codes (simple and normal, with meta prefix images), LZ77 back-references with the
two-dimensional distance map, and the colour cache, and inverts the predictor, cross-colour, subtract-green and
colour-indexing transforms. Many images are read together: a step reads the next pixel of all of them by array
operations, each from its own place in its stream. A few images are read one by one.

The encoder writes images of four channels: a palette if they have at most 256 pixels, else a colour cache, a predictor
or a cross-colour transform; LZ77 (greedy, over the latest place with the same two pixels); and Huffman codes from a few
fixed tables of weights, of which an image takes the one with the least bits.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import struct
from collections.abc import Generator
from dataclasses import dataclass

import numpy as np

# Fixed values of the WebP lossless bit stream specification.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
# Fixed values of the WebP lossless bit stream specification: (x, y) of the first 120 distance codes.
DISTANCE_MAP = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, COLOR_INDEXING = range(4)
MAX_SIDE = 1 << 14
FEW = 8  # images that are read one by one
_MAP = np.array(DISTANCE_MAP)


class WebPError(ValueError):
    """The bytes are no lossless WebP image that can be read."""


class Bits:
    """Bits of a byte string, least significant first, with some zeros after its end; and what its reader has met."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0" * 16, 0, len(data) * 8
        self.references = self.cached = 0

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise WebPError("the image ends early")
        return v


class PrefixCode:
    """A canonical prefix code as a lookup table of its longest length; entries: symbol << 4 | length."""

    def __init__(self, lengths: list[int]):
        used = sorted((n, s) for s, n in enumerate(lengths) if n) or [(0, 0)]
        if len(used) == 1:
            self.bits, self.entries = 0, np.array([used[0][1] << 4], np.int32)
            return
        if sum(1 << (15 - n) for n, _ in used) != 1 << 15:
            raise WebPError("a prefix code is not complete")
        self.bits = used[-1][0]
        self.entries = np.empty(1 << self.bits, np.int32)
        for n, s, back in canonical(used):
            self.entries[back :: 1 << n] = s << 4 | n

    @functools.cached_property
    def table(self) -> list[int]:
        return self.entries.tolist()

    def read(self, b: Bits) -> int:
        if not self.bits:
            return self.table[0] >> 4
        v = self.table[b.peek(self.bits)]
        b.at += v & 15
        if b.at > b.end:
            raise WebPError("the image ends early")
        return v >> 4


def canonical(used: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(length, symbol, code with its first bit lowest) of sorted (length, symbol) pairs."""
    out, code, last = [], 0, used[0][0]
    for n, s in used:
        code <<= n - last
        last = n
        out.append((n, s, int(f"{code:0{n}b}"[::-1], 2)))
        code += 1
    return out


_known: dict[tuple[int, int], list[tuple[int, int, PrefixCode]]] = {}


def _read_code(b: Bits, alphabet: int) -> PrefixCode:
    """The prefix code that begins here. Codes met before are known by their bits; at most 256 are kept."""
    bits = lambda at, n: (int.from_bytes(b.data[at >> 3 : (at + n >> 3) + 1], "little") >> (at & 7)) & ((1 << n) - 1)
    key = (alphabet, bits(b.at, 32))
    for n, value, code in _known.get(key, ()):
        if b.at + n <= b.end and bits(b.at, n) == value:
            b.at += n
            return code
    began = b.at
    code = _parse_code(b, alphabet)
    if sum(map(len, _known.values())) < 256:
        _known.setdefault(key, []).append((b.at - began, bits(began, b.at - began), code))
    return code


def _parse_code(b: Bits, alphabet: int) -> PrefixCode:
    lengths = [0] * alphabet
    if b.read(1):
        two = b.read(1)
        first = b.read(8 if b.read(1) else 1)
        second = b.read(8) if two else first
        if max(first, second) >= alphabet:
            raise WebPError("a symbol is not in its alphabet")
        lengths[first] = lengths[second] = 1
        return PrefixCode(lengths)
    of = [0] * 19
    for k in CODE_LENGTH_ORDER[: 4 + b.read(4)]:
        of[k] = b.read(3)
    code = PrefixCode(of)
    most = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else alphabet
    i, previous = 0, 8
    while i < alphabet and most:
        most -= 1
        s = code.read(b)
        if s < 16:
            lengths[i] = s
            previous = s or previous
            i += 1
            continue
        n, v = {16: (lambda: (3 + b.read(2), previous)), 17: (lambda: (3 + b.read(3), 0)), 18: (lambda: (11 + b.read(7), 0))}[s]()
        if i + n > alphabet:
            raise WebPError("code lengths run past their alphabet")
        lengths[i : i + n] = [v] * n
        i += n
    return PrefixCode(lengths)


def _extra(b: Bits, symbol: int) -> int:
    """The value of a length or distance prefix symbol."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + b.read(n) + 1


@dataclass
class Image:
    """An entropy-coded image whose pixels begin at the reader's place."""

    bits: Bits
    width: int
    height: int
    cache_bits: int
    groups: list[list[PrefixCode]]
    meta: np.ndarray | None  # which group each tile of 2**shift x 2**shift pixels has
    shift: int


def _entropy_image(b: Bits, width: int, height: int, top: bool) -> Generator[Image, np.ndarray, np.ndarray]:
    """Pixels (uint32 ARGB) of an entropy-coded image; only the top one may hold a meta prefix image."""
    cache_bits = 0
    if b.read(1):
        cache_bits = b.read(4)
        if not 1 <= cache_bits <= 11:
            raise WebPError("the colour cache's size is out of range")
    meta, shift = None, 0
    if top and b.read(1):
        shift = 2 + b.read(3)
        w, h = (width + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
        meta = (((yield from _entropy_image(b, w, h, False)) >> 8) & 0xFFFF).reshape(h, w)
    groups = []
    for _ in range(1 + (int(meta.max()) if meta is not None else 0)):
        groups.append([_read_code(b, n) for n in (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)])
    return (yield Image(b, width, height, cache_bits, groups, meta, shift))


def _one(image: Image) -> np.ndarray:
    """The pixels of one image, token by token."""
    b, width, meta, shift, groups = image.bits, image.width, image.meta, image.shift, image.groups
    total = width * image.height
    pixels: list[int] = [0] * total
    cache, at = [0] * (1 << image.cache_bits), 0
    pending = 0  # pixels before this one are in the cache
    while at < total:
        g = groups[int(meta[at // width >> shift, at % width >> shift])] if meta is not None else groups[0]
        s = g[0].read(b)
        if s < 256:
            red, blue, alpha = g[1].read(b), g[2].read(b), g[3].read(b)
            pixels[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            b.references += 1
            length = _extra(b, s - 256)
            d = _extra(b, g[4].read(b))
            if d > 120:
                d -= 120
            else:
                x, y = DISTANCE_MAP[d - 1]
                d = max(1, x + y * width)
            if d > at or at + length > total:
                raise WebPError("a back-reference leaves the image")
            for _ in range(length):
                pixels[at] = pixels[at - d]
                at += 1
        else:
            if image.cache_bits:
                for p in pixels[pending:at]:
                    cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - image.cache_bits)] = p
                pending = at
            b.cached += 1
            pixels[at] = cache[s - 280]
            at += 1
    return np.array(pixels, np.uint32)


def _extras(symbol: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of length or distance prefix symbols whose extra bits the windows begin with, and how many those are."""
    n = np.maximum(symbol - 2 >> 1, 0)
    more = (window & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    return np.where(symbol < 4, symbol + 1, (2 + (symbol & 1) << n) + more + 1), n


def _together(images: list[Image]) -> list[np.ndarray]:
    """The pixels of all images, read in step: the images' t-th pixels at once, for each t."""
    totals = np.array([x.width * x.height for x in images])
    order = np.argsort(-totals, kind="stable")
    images, totals = [images[i] for i in order], totals[order]
    lanes = len(images)
    data = b"".join(x.bits.data for x in images) + b"\0" * 16
    origin = 8 * np.cumsum([0, *(len(x.bits.data) for x in images[:-1])])
    eight = np.ndarray((len(data) - 8,), "<u8", data, strides=(1,))  # from each byte on
    at = origin + np.array([x.bits.at for x in images])
    end = origin + np.array([x.bits.end for x in images])
    tables, where, size = [], {}, 0
    begin, mask, first_group = [], [], []
    for x in images:
        first_group.append(len(begin))
        for group in x.groups:
            for code in group:
                if id(code) not in where:
                    where[id(code)] = size
                    tables.append(code.entries)
                    size += len(code.entries)
            begin.append([where[id(code)] for code in group])
            mask.append([(1 << code.bits) - 1 for code in group])
    table = np.concatenate(tables).astype(np.int64)
    begin, mask = np.ascontiguousarray(np.array(begin).T), np.ascontiguousarray(np.array(mask, np.uint64).T)
    long = any(sum(code.bits for code in group[:4]) > 57 for x in images for group in x.groups)
    group = np.array(first_group)
    begin_of, mask_of = begin[:, group], mask[:, group]  # of each lane
    metas = [(i, x) for i, x in enumerate(images) if x.meta is not None]
    out, base = np.zeros(int(totals.sum()), np.uint32), np.cumsum(totals) - totals
    with_cache = np.flatnonzero([x.cache_bits > 0 for x in images])
    cache_base = np.cumsum([0, *(1 << x.cache_bits if x.cache_bits else 0 for x in images)])
    cache, cache_shift = np.zeros(int(cache_base[-1]), np.uint32), np.array([32 - x.cache_bits for x in images], np.uint32)
    width = np.array([x.width for x in images])
    left, far = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)  # pixels of a reference still to be copied; from how far
    references, cached = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    copying = False
    every, counts = np.arange(lanes), lanes - np.searchsorted(totals[::-1], np.arange(int(totals[0])), "right")

    def window(p: np.ndarray) -> np.ndarray:
        """At least 57 bits from each place on."""
        return eight[np.minimum(p >> 3, len(eight) - 1)] >> (p & 7).astype(np.uint64)

    for t, n in enumerate(counts.tolist()):
        for i, x in metas:
            if i < n:
                g = first_group[i] + int(x.meta[t // x.width >> x.shift, t % x.width >> x.shift])
                begin_of[:, i], mask_of[:, i] = begin[:, g], mask[:, g]
        pixel = np.empty(n, np.uint32)
        lane: slice | np.ndarray = slice(0, n)
        if copying:
            lane = np.flatnonzero(left[:n] == 0)
        p = at[lane]
        w = window(p)
        e = table[begin_of[0, lane] + (w & mask_of[0, lane]).view(np.int64)]
        symbol, used = e >> 4, e & 15
        if symbol.max(initial=0) > 255:
            literal = symbol < 256
            lane = every[lane]
            other = np.flatnonzero(~literal)
            here, p2, s2 = lane[other], p[other] + used[other], symbol[other]
            in_cache = s2 >= 280
            if in_cache.any():
                k = here[in_cache]
                pixel[k] = cache[cache_base[k] + s2[in_cache] - 280]
                at[k] = p2[in_cache]
                cached[k] += 1
                here, p2, s2 = here[~in_cache], p2[~in_cache], s2[~in_cache]
            if len(here):
                w2 = window(p2)
                length, more = _extras(s2 - 256, w2)
                w2 >>= more.astype(np.uint64)
                e2 = table[begin_of[4, here] + (w2 & mask_of[4, here]).view(np.int64)]
                p2 += more + (e2 & 15)
                d, more = _extras(e2 >> 4, window(p2))
                near = _MAP[np.minimum(d, 120) - 1]
                d = np.where(d > 120, d - 120, np.maximum(1, near[:, 0] + near[:, 1] * width[here]))
                if (d > t).any() or (t + length > totals[here]).any():
                    raise WebPError("a back-reference leaves the image")
                at[here], left[here], far[here] = p2 + more, length, d
                references[here] += 1
                copying = True
            lane, p, w, symbol, used = (x[literal] for x in (lane, p, w, symbol, used))
        value = symbol << 8
        for k, shift in ((1, 16), (2, 0), (3, 24)):
            p = p + used
            w = window(p) if long and k == 3 else w >> used.view(np.uint64)
            e = table[begin_of[k, lane] + (w & mask_of[k, lane]).view(np.int64)]
            used = e & 15
            value |= e >> 4 << shift
        pixel[lane], at[lane] = value, p + used
        if copying:
            copy = np.flatnonzero(left[:n])
            pixel[copy] = out[base[copy] + t - far[copy]]
            left[copy] -= 1
            copying = bool(left[copy].any())
        out[base[:n] + t] = pixel
        if len(with_cache):
            k = with_cache[: int(np.searchsorted(with_cache, n))]
            v = pixel[k]
            cache[cache_base[k] + (v * np.uint32(0x1E35A7BD) >> cache_shift[k])] = v
    if (at > end).any():
        raise WebPError("the image ends early")
    got: list[np.ndarray] = [out] * lanes
    for i, x in enumerate(images):
        x.bits.at, x.bits.references, x.bits.cached = int(at[i] - origin[i]), x.bits.references + int(references[i]), x.bits.cached + int(cached[i])
        got[order[i]] = out[base[i] : base[i] + totals[i]]
    return got


def _avg(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _clip(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _channels(f, *args: int) -> int:
    return sum(_clip(f(*[(a >> s) & 255 for a in args])) << s for s in (0, 8, 16, 24))


def _select(left: int, up: int, corner: int) -> int:
    to_left = to_up = 0
    for s in (0, 8, 16, 24):
        l, u, c = (left >> s) & 255, (up >> s) & 255, (corner >> s) & 255
        to_left += abs(u - c)
        to_up += abs(l - c)
    return left if to_left < to_up else up


def _half(a: int, c: int) -> int:
    d = a - c
    return a + (d // 2 if d >= 0 else -(-d // 2))


def predict(mode: int, left: int, up: int, right: int, corner: int) -> int:
    """The predicted ARGB pixel; ``right`` stands above to the right, ``corner`` above to the left."""
    if mode in (0, 14, 15):
        return 0xFF000000
    if mode == 1:
        return left
    if mode == 2:
        return up
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _avg(_avg(left, right), up)
    if mode == 6:
        return _avg(left, corner)
    if mode == 7:
        return _avg(left, up)
    if mode == 8:
        return _avg(corner, up)
    if mode == 9:
        return _avg(up, right)
    if mode == 10:
        return _avg(_avg(left, corner), _avg(up, right))
    if mode == 11:
        return _select(left, up, corner)
    if mode == 12:
        return _channels(lambda l, u, c: l + u - c, left, up, corner)
    return _channels(_half, _avg(left, up), corner)


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _undo_predictor(px: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    if (modes == modes[0, 0]).all() and int(modes[0, 0]) in _BY_ROWS:
        return _undo_by_rows(px, width, height, int(modes[0, 0]))
    p = px.tolist()
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if not y:
                guess = p[i - 1] if x else 0xFF000000
            elif not x:
                guess = p[i - width]
            else:
                guess = predict(int(modes[y >> bits, x >> bits]), p[i - 1], p[i - width], p[i - width + 1], p[i - width - 1])
            p[i] = _add(p[i], guess)
    return np.array(p, np.uint32)


_BY_ROWS = (1, 2, 3, 4, 8, 9)


def _undo_by_rows(px: np.ndarray, width: int, height: int, mode: int) -> np.ndarray:
    """One predictor for the whole image that needs whole rows above or sums to the left only."""
    c = px.astype("<u4").view(np.uint8).reshape(height, width, 4)  # blue, green, red, alpha
    c[0, 0, 3] = (int(c[0, 0, 3]) + 255) & 255
    np.cumsum(c[0], axis=0, dtype=np.uint8, out=c[0])
    if mode == 2:
        np.cumsum(c, axis=0, dtype=np.uint8, out=c)
    elif mode == 1:
        np.cumsum(c[:, 0], axis=0, dtype=np.uint8, out=c[:, 0])
        np.cumsum(c[1:], axis=1, dtype=np.uint8, out=c[1:])
    else:
        np.cumsum(c[:, 0], axis=0, dtype=np.uint8, out=c[:, 0])
        for y in range(1, height):
            above = c[y - 1]
            right = np.concatenate((above[2:], c[y, :1]))[: width - 1]
            if mode == 3:
                guess = right
            elif mode == 4:
                guess = above[:-1]
            else:
                other = above[:-1] if mode == 8 else right
                guess = (above[1:] & other) + ((above[1:] ^ other) >> 1)
            c[y, 1:] += guess
    return c.reshape(-1).view(np.uint32)


def _undo_cross_color(px: np.ndarray, width: int, height: int, bits: int, mults: np.ndarray) -> np.ndarray:
    p = px.reshape(height, width)
    m = mults[np.arange(height)[:, None] >> bits, np.arange(width)[None] >> bits]
    signed = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    green, red, blue = signed(p >> 8), ((p >> 16) & 255).astype(np.int32), (p & 255).astype(np.int32)
    red = (red + (signed(m) * green >> 5)) & 255
    blue = blue + (signed(m >> 8) * green >> 5)
    blue = (blue + (signed(m >> 16) * signed(red.astype(np.uint32)) >> 5)) & 255
    return ((p & np.uint32(0xFF00FF00)) | red.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)).ravel()


def chunk(data: bytes) -> bytes:
    """The VP8L chunk of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebPError("no RIFF container of kind WEBP")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise WebPError("no VP8L chunk")


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file as a (height, width, 4) uint8 array in R, G, B, A order."""
    return decode_vp8l(chunk(data))


def decode_vp8l(data: bytes) -> np.ndarray:
    return decode_many([data])[0][0]


def decode_many(chunks: list[bytes]) -> list[tuple[np.ndarray, dict[str, int]]]:
    """Of each VP8L chunk the pixels, and how many transforms of each kind, back-references and cached pixels it has."""
    out: list = [None] * len(chunks)
    readers = [_read(x) for x in chunks]
    waiting = [(i, None) for i in range(len(chunks))]
    while waiting:
        asked = []
        for i, px in waiting:
            try:
                asked.append((i, readers[i].send(px)))
            except StopIteration as done:
                out[i] = done.value
        images = [x for _, x in asked]
        got = [_one(x) for x in images] if len(images) < FEW else _together(images)
        waiting = [(i, px) for (i, _), px in zip(asked, got)]
    return out


def _read(data: bytes) -> Generator[Image, np.ndarray, tuple[np.ndarray, dict[str, int]]]:
    """Reads one chunk; asks for the pixels of each entropy-coded image that it comes to."""
    if not data or data[0] != 0x2F:
        raise WebPError("no VP8L signature")
    b = Bits(data)
    b.at = 8
    width, height, alpha = b.read(14) + 1, b.read(14) + 1, b.read(1)
    if b.read(3):
        raise WebPError("unknown version")
    transforms, seen, w = [], set(), width
    size = lambda n, bits: (n + (1 << bits) - 1) >> bits
    while b.read(1):
        kind = b.read(2)
        if kind in seen:
            raise WebPError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOR):
            bits = 2 + b.read(3)
            table = (yield from _entropy_image(b, size(w, bits), size(height, bits), False)).reshape(size(height, bits), size(w, bits))
            transforms.append((kind, w, bits, (table >> 8) & 15 if kind == PREDICTOR else table))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, w, 0, None))
        else:
            n = b.read(8) + 1
            deltas = yield from _entropy_image(b, n, 1, False)
            palette = np.zeros(256, np.uint32)
            for s in (0, 8, 16, 24):
                palette[:n] |= (np.cumsum((deltas >> np.uint32(s)) & 255) & 255).astype(np.uint32) << np.uint32(s)
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, w, bits, palette))
            w = size(w, bits)
    px = yield from _entropy_image(b, w, height, True)
    for kind, tw, bits, table in reversed(transforms):
        if kind == PREDICTOR:
            px = _undo_predictor(px, tw, height, bits, table)
        elif kind == CROSS_COLOR:
            px = _undo_cross_color(px, tw, height, bits, table)
        elif kind == SUBTRACT_GREEN:
            g = (px >> np.uint32(8)) & np.uint32(255)
            px = (px & np.uint32(0xFF00FF00)) | (px + (g << np.uint32(16)) & np.uint32(0xFF0000)) | (px + g & np.uint32(255))
        else:
            index = ((px >> np.uint32(8)) & np.uint32(255)).reshape(height, -1)
            if bits:
                each = 8 >> bits
                x = np.arange(tw)
                index = index[:, x >> bits] >> ((x & ((1 << bits) - 1)) * each).astype(np.uint32) & np.uint32((1 << each) - 1)
            px = table[index[:, :tw]].ravel()
    if not alpha:
        px = px | np.uint32(0xFF000000)
    out = px.astype("<u4").view(np.uint8).reshape(height, width, 4)[:, :, [2, 1, 0, 3]]
    read = {name: int(kind in seen) for kind, name in enumerate(("predictor", "cross_colour", "subtract_green", "palette"))}
    return out, read | {"references": b.references, "cached": b.cached}


class BitWriter:
    """Bits into a byte string, least significant first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, v: int, n: int) -> BitWriter:
        self.value |= v << self.n
        self.n += n
        return self

    def append(self, values: np.ndarray, sizes: np.ndarray) -> BitWriter:
        """Values of at most 58 bits each."""
        end = np.cumsum(sizes, dtype=np.uint64)
        total = int(end[-1]) if len(end) else 0
        if total:
            begin = end - sizes
            word, shift = (begin >> np.uint64(6)).astype(np.int64), begin & np.uint64(63)
            out = np.zeros(total // 64 + 2, np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
            high = np.where(shift > 0, values >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
            out[word[first] + 1] |= np.bitwise_or.reduceat(high, first)
            self.value |= int.from_bytes(out.tobytes(), "little") << self.n
            self.n += total
        return self

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def container(chunk: bytes) -> bytes:
    pad = len(chunk) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(chunk) + pad) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + b"\0" * pad


def _code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Huffman code lengths, none above ``limit``; ties go by symbol. A symbol that is alone has length 1."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    out[used] = 1
    weight = counts[used]
    while len(used) > 2:
        heap = [(n, i, None) for i, n in enumerate(weight.tolist())]
        heapq.heapify(heap)
        number = len(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap)
            y = heapq.heappop(heap)
            heapq.heappush(heap, (x[0] + y[0], number, (x, y)))
            number += 1
        stack = [(heap[0], 0)]
        while stack:
            (_, i, pair), depth = stack.pop()
            if pair is None:
                out[used[i]] = depth
            else:
                stack += [(pair[0], depth + 1), (pair[1], depth + 1)]
        if out.max() <= limit:
            break
        weight = weight + 1 >> 1 if weight.max() > 1 else weight
    return out


def _codes(lengths: np.ndarray) -> np.ndarray:
    """Each symbol's code, its first bit lowest (0 for a symbol alone)."""
    out = np.zeros(len(lengths), np.uint64)
    used = sorted((int(lengths[s]), int(s)) for s in np.flatnonzero(lengths))
    if len(used) > 1:
        for _, s, back in canonical(used):
            out[s] = back
    return out


def _write_code(w: BitWriter, counts: np.ndarray, limit: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Write the prefix code for symbols with these counts; returns their codes and how many bits each takes."""
    used = np.flatnonzero(counts).tolist() or [0]
    if len(used) <= 2 and used[-1] < 256:
        w.put(1, 1).put(len(used) - 1, 1)
        w.put(0, 1).put(used[0], 1) if used[0] < 2 else w.put(1, 1).put(used[0], 8)
        if len(used) == 2:
            w.put(used[1], 8)
        lengths = np.zeros(len(counts), np.int64)
        lengths[used] = 1
        return _codes(lengths), lengths if len(used) == 2 else np.zeros(len(counts), np.int64)
    lengths = _code_lengths(counts, limit)
    runs: list[tuple[int, int, int]] = []  # code length symbol, extra value and bits
    for n, group in itertools.groupby(lengths.tolist()):
        many = len(list(group))
        if n:
            runs.append((n, 0, 0))
            many -= 1
        while many >= 3:
            top, symbol, least, bits = (6, 16, 3, 2) if n else (138, 18, 11, 7) if many >= 11 else (10, 17, 3, 3)
            now = min(many, top)
            runs.append((symbol, now - least, bits))
            many -= now
        runs += [(n, 0, 0)] * many
    of = _code_lengths(np.bincount([x for x, _, _ in runs], minlength=19), 7)
    order = [int(of[k]) for k in CODE_LENGTH_ORDER]
    n = max(4, max(i for i, x in enumerate(order) if x) + 1)
    w.put(0, 1).put(n - 4, 4)
    for x in order[:n]:
        w.put(x, 3)
    w.put(0, 1)
    codes, alone = _codes(of).tolist(), int((of > 0).sum()) == 1
    of = of.tolist()
    for symbol, extra, bits in runs:
        if not alone:
            w.put(codes[symbol], of[symbol])
        if bits:
            w.put(extra, bits)
    return _codes(lengths), lengths if (lengths > 0).sum() > 1 else np.zeros(len(counts), np.int64)


MAX_MATCH = 4096
MAX_DISTANCE = (1 << 20) - 120


def _parse(px: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy tokens of the pixels: where they begin, their lengths (1: no reference) and distances.

    A place refers to the latest one with the same two pixels; matches grow while the distance stays the same.
    """
    n = len(px)
    step, far = np.ones(n, np.int64), np.zeros(n, np.int64)
    if n > 2:
        key = px[:-1].astype(np.uint64) | px[1:].astype(np.uint64) << np.uint64(32)
        order = np.argsort((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16), kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        at = order[1:][same]
        if len(at):
            far[at] = at - order[:-1][same]
            far[far > MAX_DISTANCE] = 0
            edge = np.append(np.flatnonzero(far[1:] != far[:-1]), n - 1)
            last = np.repeat(edge, np.diff(edge, prepend=-1))
            size = np.minimum(last - np.arange(n) + 2, MAX_MATCH)
            use = far > 0
            step[use] = size[use]
    may = np.flatnonzero(step > 1)
    if not len(may):
        return np.arange(n), step, far
    taken, free = [], 0
    for i, size in zip(may.tolist(), step[may].tolist()):
        if i >= free:
            taken.append(i)
            free = i + size
    taken = np.array(taken)
    inner = np.zeros(n + 1, np.int64)
    inner[taken + 1] = 1
    inner[taken + step[taken]] -= 1
    chain = np.flatnonzero(np.cumsum(inner)[:n] == 0)
    length = np.ones(len(chain), np.int64)
    length[np.searchsorted(chain, taken)] = step[taken]
    return chain, length, far[chain]


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra value and number of extra bits of lengths or distances."""
    u = v - 1
    top = np.frexp(np.maximum(u, 1).astype(np.float64))[1].astype(np.int64) - 1
    n = np.where(u < 4, 0, top - 1)
    return np.where(u < 4, u, 2 * top + (u >> np.maximum(top - 1, 0) & 1)), np.where(u < 4, 0, u & (1 << n) - 1), n


@functools.lru_cache(64)
def _near(width: int) -> np.ndarray:
    """The distance code of each distance that the two-dimensional map has (else 0)."""
    d = np.maximum(1, _MAP[:, 0] + _MAP[:, 1] * width)
    out = np.zeros(int(d.max()) + 1, np.int64)
    out[d[::-1]] = np.arange(120, 0, -1)
    return out


def _cache_hits(pixel: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's place in the cache, and whether it is there when its turn comes."""
    slot = (pixel * np.uint32(0x1E35A7BD) >> np.uint32(32 - bits)).astype(np.uint16)
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(pixel), bool)
    hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (pixel[order[1:]] == pixel[order[:-1]])
    return slot.astype(np.int64), hit


_CLASSES = np.full(256, 1)
_CLASSES[128:] = 4
_CLASSES[33:127] = 6
_CLASSES[48:58] = 8
_CLASSES[10] = 6
_CLASSES[97:123] = 40
_CLASSES[[97, 101, 105, 111, 117]] = 80
_CLASSES[32] = 200
#: Weights of the byte values that a channel's Huffman code is made from, by table: prose, and any bytes.
WEIGHTS = (_CLASSES, np.full(256, 4))


@functools.lru_cache(256)
def _code(table: int, channel: int, cache_bits: int, only: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """The prefix code of a channel (0 green, 1 to 3 others, 4 distances) as bits, how many bits, codes and lengths.
    ``only`` from 0 up: this symbol alone."""
    size = 40 if channel == 4 else 256 if channel else 280 + (1 << cache_bits if cache_bits else 0)
    weights = np.zeros(size, np.int64)
    if only >= 0:
        weights[only] = 1
    elif channel == 4:
        weights[:] = 1
    else:
        weights[:256] = WEIGHTS[table]
        weights[256:264] = 2 if channel == 0 else 0
        weights[264:] = 1
    w = BitWriter()
    codes, lengths = _write_code(w, weights)
    return w.value, w.n, codes, lengths.astype(np.uint64)


def _write_image(w: BitWriter, px: np.ndarray, width: int, *, top: bool, cache_bits: int = 0, index: bool = False) -> None:
    """An entropy-coded image of ARGB pixels; only the top one has references. ``index``: only green differs."""
    w.put(bool(cache_bits), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if top:
        w.put(0, 1)
    begin, length, distance = _parse(px) if top else (np.arange(len(px)), np.ones(len(px), np.int64), np.zeros(len(px), np.int64))
    copy, cached = length > 1, np.zeros(len(begin), bool)
    if cache_bits:
        slot, hit = _cache_hits(px, cache_bits)
        cached = ~copy & hit[begin]
    literal = ~(copy | cached)
    v = px[begin[literal]]
    channels = [(v >> np.uint32(shift) & np.uint32(255)).astype(np.int64) for shift in (8, 16, 0, 24)]
    alone = len(px) == 1
    only = [int(c[0]) if k and index or alone else -1 for k, c in enumerate(channels)]
    best = 0
    if not (index or alone):
        count = np.bincount(v.view(np.uint8), minlength=256)
        best = int(np.argmin([int(count @ _code(t, 1, 0, -1)[3].astype(np.int64)) for t in range(len(WEIGHTS))]))
    codes = [_code(best, k, cache_bits, only[k]) for k in range(4)] + [_code(best, 4, 0, -1 if copy.any() else 0)]
    for value, n, _, _ in codes:
        w.put(value, n)
    fields = np.zeros((4, 2, len(begin)), np.uint64)  # values and their bits
    at = slice(None) if literal.all() else literal
    for k, c in enumerate(channels):
        if codes[k][3].any():
            fields[k, 0, at], fields[k, 1, at] = codes[k][2][c], codes[k][3][c]
    if cached.any():
        symbol = 280 + slot[begin[cached]]
        fields[0, 0, cached], fields[0, 1, cached] = codes[0][2][symbol], codes[0][3][symbol]
    if copy.any():
        near, d = _near(width), distance[copy]
        mapped = near[np.minimum(d, len(near) - 1)]
        d = np.where((d < len(near)) & (mapped > 0), mapped, d + 120)
        (ls, lx, ln), (ds, dx, dn) = _prefix(length[copy]), _prefix(d)
        for k, (x, n) in enumerate(((codes[0][2][256 + ls], codes[0][3][256 + ls]), (lx, ln), (codes[4][2][ds], codes[4][3][ds]), (dx, dn))):
            fields[k, 0, copy], fields[k, 1, copy] = x, n
    value, size = fields[0, 0].copy(), fields[0, 1].copy()
    for x, n in fields[1:]:
        value |= x << size
        size += n
    w.append(value, size)


#: One tile of a predictor or cross-colour table covers 2**9 x 2**9 pixels.
_TILE_BITS = 9
PREDICTORS = (1, 2, 3, 4, 8, 9)


CACHE_BITS = 8


def encode(px: np.ndarray, width: int, height: int, deal: int) -> bytes:
    """A lossless WebP file of ARGB pixels (uint32, row after row).

    At most 256 pixels make a palette. For other images ``deal`` chooses between a colour cache, a predictor (one of
    ``PREDICTORS``) and cross-colour, so that a column of images has all of them.
    """
    w = BitWriter()
    w.put(0x2F, 8).put(width - 1, 14).put(height - 1, 14).put(1, 1).put(0, 3)
    opaque = np.uint32(0xFF000000)
    if max(width, height) > 1 << _TILE_BITS:
        raise WebPError("images of one tile are written: at most 512 x 512 pixels")
    cache_bits, kind, deal, index = 0, deal % 3, deal // 3, False
    colours, place = np.unique(px, return_inverse=True) if len(px) <= 256 else (None, None)
    if colours is not None:
        n, index = len(colours), True
        c = colours.astype("<u4").view(np.uint8).reshape(-1, 4)
        deltas = np.diff(c, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
        w.put(1, 1).put(COLOR_INDEXING, 2).put(n - 1, 8)
        _write_image(w, np.ascontiguousarray(deltas).view("<u4").ravel(), n, top=False)
        green = place.astype(np.uint8)
        bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        if bits:
            each, row = 8 >> bits, np.zeros((height, -(-width // (1 << bits)) << bits), np.uint8)
            row[:, :width] = green.reshape(height, width)
            green = (row.reshape(height, -1, 1 << bits) << (np.arange(1 << bits) * each).astype(np.uint8)).sum(2, dtype=np.uint8).ravel()
            width = width + (1 << bits) - 1 >> bits
        px = green.astype(np.uint32) << np.uint32(8) | opaque
    elif kind == 0:
        cache_bits = CACHE_BITS
    elif kind == 1:
        mode = PREDICTORS[deal % len(PREDICTORS)]
        w.put(1, 1).put(PREDICTOR, 2).put(_TILE_BITS - 2, 3)
        _write_image(w, np.array([opaque | np.uint32(mode << 8)]), 1, top=False)
        c = px.astype("<u4").view(np.uint8).reshape(height, width, 4)  # blue, green, red, alpha
        guess = np.zeros_like(c)
        guess[0, 0, 3] = 255
        guess[0, 1:], guess[1:, 0] = c[0, :-1], c[:-1, 0]
        above, left, corner = c[:-1, 1:], c[1:, :-1], c[:-1, :-1]
        if mode in (3, 9):
            right = np.concatenate((c[:-1, 2:], c[1:, :1]), 1)[:, : width - 1]
        mean = lambda a, b: (a & b) + ((a ^ b) >> 1)
        guess[1:, 1:] = left if mode == 1 else above if mode == 2 else right if mode == 3 else corner if mode == 4 else mean(corner if mode == 8 else right, above)
        px = np.ascontiguousarray(c - guess).view("<u4").ravel()
    else:
        to_red, to_blue, red_to_blue = deal % 256, deal // 256 % 256, deal // 65536 % 256
        w.put(1, 1).put(CROSS_COLOR, 2).put(_TILE_BITS - 2, 3)
        table = opaque | np.uint32(red_to_blue << 16 | to_blue << 8 | to_red)
        _write_image(w, np.array([table]), 1, top=False)
        signed = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int32)
        m = [int(signed(np.array([x]))[0]) for x in (to_red, to_blue, red_to_blue)]
        green, red = signed(px >> 8), signed(px >> 16)
        new_red = (px >> np.uint32(16) & np.uint32(255)).astype(np.int32) - (m[0] * green >> 5) & 255
        new_blue = (px & np.uint32(255)).astype(np.int32) - (m[1] * green >> 5) - (m[2] * red >> 5) & 255
        px = (px & np.uint32(0xFF00FF00)) | new_red.astype(np.uint32) << np.uint32(16) | new_blue.astype(np.uint32)
    w.put(0, 1)
    _write_image(w, px, width, top=True, cache_bits=cache_bits, index=index)
    return container(w.bytes())


def image_size(n_pixels: int) -> tuple[int, int]:
    """Width and height of a nearly square image of at least ``n_pixels``; more than 16384 x 16384 raises."""
    width = max(16, 16 * -(-int(np.ceil(np.sqrt(n_pixels))) // 16))
    height = max(1, -(-n_pixels // width))
    if width > MAX_SIDE or height > MAX_SIDE:
        raise WebPError("an image holds at most 16384 x 16384 pixels")
    return width, height
