"""Vectorised word handling over Arrow string batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased first. Whole texts only:
batches are cut between documents, never inside one. Words and n-grams are carried as 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15 | 1
_P = (_P & ~7) | 5  # 5 mod 8: the order of its powers is as large as can be
_PINV = pow(_P, -1, 2**64)
_Q = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = _BYTE[_LOWER]
_pow: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> list[np.ndarray]:
    if len(_pow[0]) < n + 1:
        m = max(n + 1, 1 << 16)
        for i, p in enumerate((_P, _PINV)):
            a = np.full(m, p, U64)
            a[0] = 1
            _pow[i] = np.multiply.accumulate(a)
    return _pow


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array (null: empty), and the n + 1 offsets of its values."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string()) if not pa.types.is_large_string(arr.type) else arr
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about ``limit`` bytes of ``column``; a longer row stands alone."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    _, off = raw(col)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each byte run (A-Z as a-z)."""
    power, inverse = _powers(len(data))
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(U64) * U64(_Q[0]))


def prefix_hashes(w: Words, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size, the words longer than it (their indices) and a fingerprint of their first bytes."""
    out = []
    if not len(w.starts):
        return [(np.zeros(0, np.int64), np.zeros(0, U64)) for _ in sizes]
    power, inverse = _powers(len(w.data))
    sums = np.empty(len(w.data) + 1, U64)
    sums[0] = 0
    np.cumsum(_BYTE[w.data] * power[: len(w.data)], out=sums[1:])
    size = w.ends - w.starts
    for k in sizes:
        at = np.flatnonzero(size > k)
        i = w.starts[at]
        out.append((at, mix((sums[i + k] - sums[i]) * inverse[i] + U64(k * _Q[1] + 1 & 2**64 - 1))))
    return out


def spans(off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``inside`` holds; no run crosses a document's end."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


@dataclass
class Words:
    hashes: np.ndarray  # of all words, document after document
    bounds: np.ndarray  # n + 1: where each document's words begin
    starts: np.ndarray  # byte offsets in data
    ends: np.ndarray
    data: np.ndarray
    off: np.ndarray


def words(arr: pa.Array) -> Words:
    data, off = raw(arr)
    starts, ends = spans(off, ~_SPACE[data])
    return Words(word_hashes(data, starts, ends), np.searchsorted(starts, off), starts, ends, data, off)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the n-grams that begin at each place but the last n - 1 (document ends are the caller's)."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, n, U64)
    for j in range(n):
        out = mix(out * U64(_Q[j % 5]) + h[j : j + m])
    return out


def shingle_sets(w: Words, n: int = 5) -> list[np.ndarray]:
    """The distinct n-word shingles of each document, sorted; the whole sequence as one if it is shorter."""
    g, b, out = grams(w.hashes, n), w.bounds, []
    for i, j in zip(b[:-1].tolist(), b[1:].tolist()):
        if j - i >= n:
            x = np.sort(g[i : j - n + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            out.append(x)
        elif j > i:
            out.append(grams(w.hashes[i:j], j - i))
        else:
            out.append(np.zeros(0, U64))
    return out


_KIND = np.full(256, 2, np.uint8)  # 0 space, 1 letters, digits and all bytes beyond ASCII, 2 punctuation
_KIND[_SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def tokens(arr: pa.Array) -> tuple[Words, np.ndarray]:
    """Runs of letters and digits, and runs of punctuation, as words; and whether each is punctuation."""
    data, off = raw(arr)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), np.zeros(len(off), np.int64), z, z, data, off), np.zeros(0, bool)
    kind = _KIND[data]
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change[off] = True
    edge = np.flatnonzero(change)
    keep = kind[edge[:-1]] > 0
    starts, ends = edge[:-1][keep], edge[1:][keep]
    return Words(word_hashes(data, starts, ends), np.searchsorted(starts, off), starts, ends, data, off), kind[starts] == 2


def terms(arr: pa.Array) -> Words:
    """Runs of letters and digits only."""
    w, mark = tokens(arr)
    keep = ~mark
    before = np.concatenate(([0], np.cumsum(keep)))
    return Words(w.hashes[keep], before[w.bounds], w.starts[keep], w.ends[keep], w.data, w.off)


def sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``x`` (rows) between successive bounds; empty ranges give zero."""
    out = np.zeros((len(bounds) - 1, *x.shape[1:]), np.float64 if x.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(x, bounds[:-1][full], axis=0, dtype=out.dtype)
    return out
