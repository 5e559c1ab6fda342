"""Vectorised hashing of words and byte strings, straight from Arrow's buffers.

A span of bytes is hashed eight bytes at a time, a window of words by doubling: each step mixes two values by a
bijection of either, so no run of bytes is special as it is to a polynomial modulo 2**64. Where a hash stands for the
content itself, two of different seeds are taken, 128 bits. Work goes block by block of whole documents, to bound memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95), U(0xA24BAED4963EE407)
#: Bytes that are looked at together; a longer document is a block of its own.
BLOCK = 1 << 20
#: Spans up to this many bytes are hashed side by side, longer ones one by one.
LONG = 512
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes, in order."""
    return mix(a * _A + (b ^ _B))


def column_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary column; null is empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.string())
    if a.null_count:
        a = a.fill_null("" if pa.types.is_string(a.type) or pa.types.is_large_string(a.type) else b"")
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = a.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about BLOCK bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the end. A view of a copy of ``data``."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, x8: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the bytes from start to end, by content and length. ``x8``: :func:`eights` of ``data``."""
    size = end - start
    h = mix(size.astype(U) * _C + U(seed))
    who, done = np.flatnonzero(size <= LONG), 0
    while len(who := who[size[who] > done]):
        x, left = x8[start[who] + done], size[who] - done
        ends = np.flatnonzero(left < 8)
        x[ends] &= (U(1) << (left[ends] * 8).astype(U)) - U(1)
        h[who] = mix(h[who] ^ x) * _A
        done += 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


class Words:
    """The words of a block: byte places, hashes, and where each document's words begin."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        n = len(data)
        if lower:
            data = LOWER[data]
        inside = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        begins = inside & (~before | edge[:n])
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        ends = inside & (~after | edge[1:])
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.data, self.x8 = data, eights(data)
        self.hash = span_hash(data, self.x8, self.start, self.end)
        self.first = np.searchsorted(self.start, off)
        self.begins, self.inside = begins, inside
        self.count = np.diff(self.first)

    def second(self) -> np.ndarray:
        """Hashes of the words by another seed."""
        return span_hash(self.data, self.x8, self.start, self.end, 1)

    def starts(self, width: int) -> np.ndarray:
        """Start words of all windows of ``width`` words within a document."""
        n = len(self.hash)
        if n < width:
            return np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(self.count)), self.count)
        return np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])

    def rolling(self, width: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(start word, hash)`` of all windows of ``width`` words within a document."""
        x = self.hash if words is None else words
        at = self.starts(width)
        if not len(at):
            return at, np.zeros(0, U)
        n, levels = len(x) - width + 1, [x]
        while 2 << (len(levels) - 1) <= width:
            step = 1 << (len(levels) - 1)
            levels.append(joined(levels[-1][:-step], levels[-1][step:]))
        h, done = None, 0
        for k in range(len(levels) - 1, -1, -1):
            if width >> k & 1:
                piece = levels[k][done : done + n]
                h = piece if h is None else joined(h, piece)
                done += 1 << k
        return at, mix(h[at] + U(width))

    def rolling128(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start word, hash, hash by another seed)`` of all windows."""
        at, h = self.rolling(width)
        return at, h, self.rolling(width, self.second())[1]

    def whole(self, width: int) -> np.ndarray:
        """Hash of the whole word sequence of each document with less than ``width`` words; of others, of its start."""
        out = np.full(len(self.count), _C, U)
        for k in range(min(width - 1, int(self.count.max(initial=0)))):
            has = self.count > k
            out[has] = joined(out[has], self.hash[self.first[:-1][has] + k])
        return mix(out + self.count.astype(U))


def packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, 4 bytes each where they fit."""
    d = np.diff(values, prepend=U(0))
    if len(values) and d[1:].max(initial=0) < 2**32:
        return b"\x01" + values[:1].tobytes() + d[1:].astype(np.uint32).tobytes()
    return b"\x00" + values.tobytes()


def unpacked(body: bytes) -> np.ndarray:
    if body[:1] == b"\x00":
        return np.frombuffer(body, U, offset=1)
    first, rest = np.frombuffer(body, U, 1, 1), np.frombuffer(body, np.uint32, offset=9)
    return np.cumsum(np.concatenate([first, rest.astype(U)]), dtype=U)


def by_bucket(values: np.ndarray, bits: int, n: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of sorted ``values`` of ``bits`` bits that fall into each of ``n`` equal parts of their space."""
    cuts = np.array([(i << bits) // n for i in range(1, n)], dtype=U)
    at = [0, *np.searchsorted(values, cuts).tolist(), len(values)]
    for i in range(n):
        if at[i] < at[i + 1]:
            yield i, at[i], at[i + 1]


def in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
