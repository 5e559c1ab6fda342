"""Repeated byte strings by a logarithmic family of sparse suffix arrays.

Which suffixes are indexed is chosen by content: a string of ``width`` bytes has one anchor, the place of the
smallest 16-byte hash among its first ``REACH``. Equal strings have their anchors at the same offset, so two
of them meet as suffixes that share at least ``width - REACH + 1`` bytes after the anchor and the bytes before it.

1. Chunks of documents send fingerprints of what follows their anchors; those that occur twice anywhere are live.
2. Live suffixes travel, with the bytes to the left that strings of theirs reach, to buckets by fingerprint.
   In a bucket, batches arrive one after another: each gets a suffix array (sorted by the bytes after the
   anchor, with longest common prefixes, and the same for the reversed bytes before it), is scanned against each
   level of the family for common strings, and levels of about equal size are merged, so that
   a suffix is merged a logarithmic number of times.
3. What was found goes back to the chunks as offsets of repeated strings, whose bytes are removed.

:func:`add_batch` keeps the families on disk, so that a later batch meets the earlier ones.

Equal contexts of a chunk travel once, so a passage of a third of all documents is one entry for each chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.bytehash import BLOCK, U, by_bucket, column_bytes, eights, joined, mix, packed, span_hash, unpacked
from siltwork.llm.common import save
from siltwork.llm.substring import SENT, answers, classes, in_chunks, place_of, sent, times

#: Places a string may have its anchor at, and bytes of the hash that chooses it.
REACH, GRAM = 128, 16
_POS = 28  # bits of a place within a block
_BITS = 43
_BATCH = 20_000
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, times long"


def segments(off: np.ndarray, width: int):
    """Ranges of bytes, each with the documents in it: whole documents, or a part of a long one.

    Yields ``(first byte, end byte, offsets within)``; strings start in a part wherever they end in it, and
    parts overlap by ``width - 1`` bytes, so each string of a document starts in exactly one.
    """
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1)
        j = min(j, n)
        if off[j] - off[i] <= 2 * BLOCK:
            yield int(off[i]), int(off[j]), off[i : j + 1] - off[i]
        else:
            a, end = int(off[i]), int(off[j])
            while a < end:
                b = min(a + BLOCK + width - 1, end)
                yield a, b, np.array([0, b - a])
                a += BLOCK
                if end - a < width:
                    break
        i = j


class Anchors:
    """The anchors of a segment: place ``a``, first and last string start ``lo``, ``hi`` that have it."""

    def __init__(self, data: np.ndarray, off: np.ndarray, width: int):
        n = len(data)
        self.a = self.lo = self.hi = np.zeros(0, np.int64)
        if n < width:
            return
        self.data, self.x8 = data, eights(data)
        at = np.arange(n - GRAM + 1)
        x8 = self.x8[: n - 7].copy()
        m = joined(x8[: len(at)], x8[8 : 8 + len(at)]) >> U(_POS) << U(_POS) | at.astype(U)
        step = 1
        while step < REACH:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        ends = np.repeat(off[1:], np.diff(off))
        s = np.flatnonzero(np.arange(n) + width <= ends)
        if not len(s):
            return
        a = (m[s] & U((1 << _POS) - 1)).astype(np.int64)
        new = np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]
        first = np.flatnonzero(new)
        self.a, self.lo, self.hi = a[first], s[first], s[np.r_[first[1:], len(s)] - 1]

    def fingerprints(self, width: int) -> np.ndarray:
        """Of the bytes that every string with the anchor has after it."""
        if not len(self.a):
            return np.zeros(0, U)
        return span_hash(self.data, self.x8, self.a, self.a + width - REACH + 1)

    def contexts(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Two halves of one number for anchors with equal bytes in all their strings and equal offsets."""
        if not len(self.a):
            return np.zeros(0, U), np.zeros(0, U)
        at = (self.a - self.lo).astype(U)
        return tuple(mix(span_hash(self.data, self.x8, self.lo, self.hi + width, seed) + at * U(0xC2B2AE3D27D4EB4F)) for seed in (0, 1))


def live(table: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk its fingerprints that occur twice, here (a mark) or in two chunks."""
    chunks, bodies = table["chunk"].to_pylist(), [unpacked(x.as_py()) for x in table["body"]]
    if not bodies:
        return answers([])
    v = np.concatenate(bodies)
    who = np.repeat(np.arange(len(bodies)), [len(b) for b in bodies])
    order = np.argsort(v, kind="stable")
    v, who = v[order], who[order]
    h = v >> U(1)
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    n = np.diff(np.r_[first, len(h)])
    ok = np.repeat(n > 1, n) | ((v & U(1)) > 0)
    h, who = h[ok], who[ok]
    order = np.argsort(who, kind="stable")
    h, who = h[order], who[order]
    at = np.searchsorted(who, np.arange(len(chunks) + 1))
    return answers([(c, packed(h[a:b])) for c, a, b in zip(chunks, at[:-1], at[1:], strict=True) if b > a])


class Level:
    """A sparse suffix array: offsets into a store of bytes, sorted by fingerprint and the bytes after the anchor.

    An entry is an anchor with the bytes of all its strings, from ``start``: ``high`` of them before the anchor, the anchor
    included ``width - low`` after. ``c, d``: its context, ``who``: where it came from; ``found``: bits of the offsets before the anchor
    whose string occurs in another entry too.
    """

    def __init__(self, width: int, store, f, c, d, who, low, high, start, found):
        self.width, self.store = width, store
        self.f, self.c, self.d, self.who, self.low, self.high, self.start, self.found = f, c, d, who, low, high, start, found

    @property
    def parts(self):
        return self.f, self.c, self.d, self.who, self.low, self.high, self.start, self.found

    def __len__(self):
        return len(self.f)

    def take(self, rows: np.ndarray) -> Level:
        return Level(self.width, self.store, *(p[rows] for p in self.parts))

    def after(self) -> np.ndarray:
        """The bytes after each anchor, padded with zeros."""
        at = np.arange(self.width)
        mid = self.start + self.high
        return np.where(at < (self.width - self.low)[:, None], self.store[np.minimum(mid[:, None] + at, len(self.store) - 1)], 0).astype(np.uint8)

    def before(self) -> np.ndarray:
        """The bytes before each anchor, the nearest first, padded with zeros."""
        at = np.arange(REACH - 1)
        mid = self.start + self.high
        return np.where(at < self.high[:, None], self.store[np.maximum(mid[:, None] - 1 - at, 0)], 0).astype(np.uint8)

    def sorted(self) -> Level:
        return self.take(np.argsort(_keys(self.f, self.after()), kind="stable"))

    def compact(self) -> Level:
        """The same with a store of its own bytes alone."""
        size = self.high - self.low + self.width
        end = np.cumsum(size)
        store = self.store[np.repeat(self.start - end + size, size) + np.arange(end[-1] if len(end) else 0)]
        return Level(self.width, store, *self.parts[:6], end - size, self.found)

    def merged(self, other: Level) -> tuple[Level, np.ndarray]:
        """Both in one array, by merging: neither is sorted again. And where the entries of ``other`` are."""
        at = np.searchsorted(_keys(self.f, self.after()), _keys(other.f, other.after()), "right") + np.arange(len(other))
        mine = np.ones(len(self) + len(other), bool)
        mine[at] = False
        out = []
        for x, y in zip(self.parts, (*other.parts[:6], other.start + len(self.store), other.found), strict=True):
            z = np.empty((len(mine), *x.shape[1:]), x.dtype)
            z[mine], z[at] = x, y
            out.append(z)
        return Level(self.width, np.concatenate([self.store, other.store]), *out), at


def _keys(f: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Byte strings that sort by fingerprint, then bytes."""
    keyed = np.ascontiguousarray(np.concatenate([f.astype(">u8").view(np.uint8).reshape(-1, 8), rows], axis=1))
    return keyed.view(f"S{keyed.shape[1]}").ravel()


def _common(f: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Common prefix of each sorted row with the one before; -1 at a new fingerprint."""
    differ = rows[1:] != rows[:-1]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.r_[-1, np.where(f[1:] == f[:-1], n, -1)]


def scan(x: Level, width: int) -> None:
    """Mark in ``x.found`` the offsets whose string occurs in two entries.

    For offset o the string is the o bytes before the anchor and width - o after it: entries agree on
    the right where they share an interval of the suffix array at depth width - o, and on the left where
    they share one of the reversed array at depth o.
    """
    n = len(x)
    if n < 2:
        return
    # only entries that share their fingerprint with another can match
    lcp_right = _common(x.f, x.after())
    near = np.maximum(lcp_right, np.r_[lcp_right[1:], -1])
    if near.max() < width - REACH + 1:
        return
    before = x.before()
    order = np.argsort(_keys(x.f, before), kind="stable")
    lcp_left = _common(x.f[order], before[order])
    found = np.unpackbits(x.found, axis=1)
    for o in range(REACH):
        ok = (x.low <= o) & (o <= x.high) & (near >= width - o)
        if ok.sum() < 2:
            continue
        right = np.cumsum(lcp_right < width - o)
        left = np.empty(n, np.int64)
        left[order] = np.cumsum(lcp_left < o)
        pick = np.flatnonzero(ok)
        key = right[pick] * (n + 1) + left[pick]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        found[pick[by[np.r_[same, False] | np.r_[False, same]]], o] = 1
    x.found = np.packbits(found, axis=1)


class Family:
    """Levels of growing size. ``add`` scans a batch against every level, then merges levels of about equal size."""

    def __init__(self, width: int, levels: list[Level] | None = None):
        self.width, self.levels = width, levels or []

    def add(self, batch: Level) -> None:
        new = batch.sorted()
        scan(new, self.width)
        for old in self.levels:
            # only fingerprints of both can be common strings of a new and an old suffix
            a, b = np.flatnonzero(_in(old.f, new.f)), np.flatnonzero(_in(new.f, old.f))
            if not len(a):
                continue
            both, at = old.take(a).compact().merged(new.take(b).compact())
            scan(both, self.width)
            mine = np.ones(len(both), bool)
            mine[at] = False
            old.found[a] |= both.found[mine]
            new.found[b] |= both.found[at]
        while self.levels and len(self.levels[-1]) <= 2 * len(new):
            new = self.levels.pop().merged(new)[0]
        self.levels.append(new)


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _segments_of(table: pa.Table, width: int):
    data, off = column_bytes(table["text"])
    for a, b, o in segments(off, width):
        yield a, data[a:b], Anchors(data[a:b], o, width)


def _locally(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which 128-bit values occur twice."""
    order, first = classes(c, d)
    out = np.zeros(len(c), bool)
    if len(first):
        size = np.diff(np.r_[first, len(c)])
        out[order] = np.repeat(size > 1, size)
    return out


def _offer(table, chunk: int, width: int, n_buckets: int, known: np.ndarray | None) -> pa.Table:
    """Suffixes with a ``known`` fingerprint (all, if it is None), each context once: fingerprint, context, offsets, bytes of all its strings."""
    got, seen = [], (np.zeros(0, U), np.zeros(0, U))
    for _, data, x in _segments_of(table, width):
        f, (c, e) = x.fingerprints(width), x.contexts(width)
        take = np.arange(len(f)) if known is None else np.flatnonzero(_in(f >> U(64 - _BITS), known))
        order, first = classes(c[take], e[take])
        take = take[order[first]]
        take = take[place_of(c[take], e[take], *seen) < 0]
        order = np.argsort(np.r_[seen[0], c[take]], kind="stable")
        seen = tuple(np.r_[s, v[take]][order] for s, v in zip(seen, (c, e), strict=True))
        if not len(take):
            continue
        lo, size = x.lo[take], x.hi[take] - x.lo[take] + width
        end = np.cumsum(size)
        flat = data[np.repeat(lo - end + size, size) + np.arange(end[-1])]
        got.append((f[take], c[take], e[take], (x.a - x.hi)[take].astype(np.uint8), (x.a - x.lo)[take].astype(np.uint8), size, flat))
    if not got:
        return sent([])
    f, c, e, low, high, size, flat = (np.concatenate(p) for p in zip(*got, strict=True))
    start = np.cumsum(size) - size
    order = np.argsort(f, kind="stable")
    rows = []
    for b, x, y in by_bucket(f[order], 64, n_buckets):
        pick = order[x:y]
        n = size[pick]
        end = np.cumsum(n)
        body = flat[np.repeat(start[pick] - end + n, n) + np.arange(end[-1])]
        rows.append((b, chunk, np.int64(len(pick)).tobytes() + b"".join(v[pick].tobytes() for v in (f, c, e, low, high)) + body.tobytes()))
    return sent(rows)


def _batches(table):
    part, total = [], 0
    for k, body in enumerate(table["body"]):
        part.append((k, body.as_py()))
        total += int(np.frombuffer(part[-1][1], np.int64, 1)[0])
        if total >= _BATCH:
            yield part
            part, total = [], 0
    if part:
        yield part


def _entries(part, width: int) -> Level:
    """A batch, not sorted yet, of what chunks offered; ``who`` is the number of the message."""
    out, total = [], 0
    for k, body in part:
        n = int(np.frombuffer(body, np.int64, 1)[0])
        f, c, e = (np.frombuffer(body, U, n, 8 + 8 * n * i) for i in range(3))
        low, high = (np.frombuffer(body, np.uint8, n, 8 + 24 * n + n * i).astype(np.int64) for i in range(2))
        flat = np.frombuffer(body, np.uint8, offset=8 + 26 * n)
        size = high - low + width
        out.append((flat, f, c, e, np.full(n, k), low, high, total + np.cumsum(size) - size, np.zeros((n, REACH // 8), np.uint8)))
        total += len(flat)
    return Level(width, *(np.concatenate(p) for p in zip(*out, strict=True)))


def _answers(family: Family, chunks: list[int]) -> list[tuple[int, bytes]]:
    """For each chunk its contexts with the offsets of strings that occur elsewhere."""
    rows = []
    for x in family.levels:
        hit = np.flatnonzero((x.who >= 0) & x.found.any(axis=1))
        hit = hit[np.argsort(x.who[hit], kind="stable")]
        c, e, bits = x.c[hit], x.d[hit], x.found[hit]
        at = np.searchsorted(x.who[hit], np.arange(len(chunks) + 1))
        rows += [(k, c[a:b].tobytes() + e[a:b].tobytes() + bits[a:b].tobytes()) for k, a, b in zip(chunks, at[:-1], at[1:], strict=True) if b > a]
    return rows


def _dumped(x: Level) -> bytes:
    """A level as bytes; where its entries came from and what was found are not kept."""
    return np.array([len(x), len(x.store)], np.int64).tobytes() + b"".join(np.ascontiguousarray(v).tobytes() for v in (x.f, x.c, x.d, x.low.astype(np.uint8), x.high.astype(np.uint8), x.start.astype(np.int64), x.store))


def _loaded(body: bytes, width: int) -> Level:
    n, size = np.frombuffer(body, np.int64, 2).tolist()
    f, c, d = (np.frombuffer(body, U, n, 16 + 8 * n * i) for i in range(3))
    low, high = (np.frombuffer(body, np.uint8, n, 16 + 24 * n + n * i).astype(np.int64) for i in range(2))
    start, store = np.frombuffer(body, np.int64, n, 16 + 26 * n), np.frombuffer(body, np.uint8, size, 16 + 34 * n)
    return Level(width, store, f, c, d, np.full(n, -1), low, high, start, np.zeros((n, REACH // 8), np.uint8))


def _finish(table, back, width: int) -> pa.Table:
    data, off = column_bytes(table["text"])
    bodies = [x.as_py() for x in back["body"]]
    size = 16 + REACH // 8
    known, second = (np.concatenate([np.frombuffer(x, U, len(x) // size, len(x) // size * 8 * i) for x in bodies]) if bodies else np.zeros(0, U) for i in range(2))
    bits = np.concatenate([np.frombuffer(x, np.uint8, offset=len(x) // size * 16).reshape(-1, REACH // 8) for x in bodies]) if bodies else np.zeros((0, REACH // 8), np.uint8)
    order = np.argsort(known, kind="stable")
    known, second, bits = known[order], second[order], bits[order]
    got = [(a, x.a + a, x.lo + a, x.hi + a, *x.contexts(width)) for a, _, x in _segments_of(table, width)]
    a, lo, hi, c, e = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (1, 2, 3, 4, 5))
    depth = np.zeros(len(data) + width + 1, np.int32)
    twice = _locally(c, e) if len(c) else np.zeros(0, bool)
    np.add.at(depth, lo[twice], 1)
    np.subtract.at(depth, hi[twice] + width, 1)
    if len(known) and len(c):
        at = place_of(c, e, known, second)
        hit = np.flatnonzero((at >= 0) & ~twice)
        for k in range(0, len(hit), 50_000):
            part = hit[k : k + 50_000]
            row, o = np.nonzero(np.unpackbits(bits[at[part]], axis=1))
            s = a[part[row]] - o
            np.add.at(depth, s, 1)
            np.subtract.at(depth, s + width, 1)
    gone = np.cumsum(depth)[: len(data)] > 0
    starts = gone.copy()
    starts[1:] &= ~gone[:-1]
    first = off[:-1][np.diff(off) > 0]
    starts[first] = gone[first]
    removed, spans = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(starts)]
    text = data[~gone].tobytes()
    left = np.r_[0, np.cumsum(~gone)][off].tolist()
    return pa.table(
        {
            "doc_id": table["doc_id"],
            "n_bytes": pa.array(np.diff(off), pa.int64()),
            "n_removed": pa.array(removed[off[1:]] - removed[off[:-1]], pa.int64()),
            "n_spans": pa.array(spans[off[1:]] - spans[off[:-1]], pa.int64()),
            "kept": pa.array([text[x:y] for x, y in zip(left[:-1], left[1:], strict=True)], pa.binary()),
            "times": table["times"],
        }
    )


def remove_repeats(docs: DataFrame, width: int = 200, chunk_bytes: int = 4 << 20) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept binary``.

    A byte goes when a string of ``width`` bytes (``width`` > REACH + GRAM) that covers it also starts anywhere else, in the
    same document too; overlaps count, and strings are judged on the input. Strings do not cross documents.
    Null and empty texts have no bytes. Repeated rows are other places; an empty table returns no rows; other
    columns are ignored. ``kept`` may split a character, so it is binary.
    """
    if width <= REACH + GRAM:
        raise ValueError(f"width must exceed {REACH + GRAM}")
    d, n = in_chunks(docs, chunk_bytes, copies=2)
    n_buckets = max(1, n // 2)

    def probe(key, table):
        f = [x.fingerprints(width) >> U(64 - _BITS) for _, _, x in _segments_of(table, width)]
        f = np.sort(np.concatenate(f)) if f else np.zeros(0, U)
        first = np.r_[True, f[1:] != f[:-1]] if len(f) else np.zeros(0, bool)
        n = np.diff(np.r_[np.flatnonzero(first), len(f)])
        v = f[first] << U(1) | (n > 1).astype(U)
        return sent([(b, key[0].as_py(), packed(v[x:y])) for b, x, y in by_bucket(v, _BITS + 1, n_buckets)])

    def offer(key, table, back):
        known = [unpacked(x.as_py()) for x in back["body"]]
        known = np.unique(np.concatenate(known)) if known else np.zeros(0, U)
        return _offer(table, key[0].as_py(), width, n_buckets, known) if len(known) and table.num_rows else sent([])

    def bucket(key, table):
        family = Family(width)
        for part in _batches(table):
            family.add(_entries(part, width))
        return answers(_answers(family, table["chunk"].to_pylist()))

    hits = d.groupBy("chunk").applyInArrow(probe, SENT).groupBy("bucket").applyInArrow(live, "chunk long, body binary")
    offered = d.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(offer, SENT)
    found = offered.groupBy("bucket").applyInArrow(bucket, "chunk long, body binary")
    return times(d.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(lambda t, back: _finish(t, back, width), RESULT))


def add_batch(docs: DataFrame, index: str, width: int = 200, chunk_bytes: int = 4 << 20, buckets: int = 64) -> DataFrame:
    """:func:`remove_repeats` of a new batch against itself and all batches added to ``index`` before, a folder that all executors see.

    The index holds every suffix of its batches at an anchor with its bytes (some four times the text), as a family of levels for each of
    ``buckets`` ranges of fingerprints, fixed by the first batch. A new batch is scanned against the levels and merged into them;
    the new family is a folder of its own, beside the last one. Documents of earlier batches are not returned again. A bucket's family
    is held by one task: ``buckets`` grows with the corpus.
    """
    if width <= REACH + GRAM:
        raise ValueError(f"width must exceed {REACH + GRAM}")
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(index)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(int(x.getPath().getName()) for x in fs.listStatus(path)) if fs.exists(path) else []
    schema = "bucket int, buckets int, level int, body binary"
    old = spark.read.schema(schema).parquet(f"{index}/{versions[-1]}") if versions else spark.createDataFrame([], schema)
    if versions and (row := old.select("buckets").first()):
        buckets = row["buckets"]
    d, _ = in_chunks(docs, chunk_bytes, copies=2)

    def bucket(key, table, saved):
        family = Family(width, [_loaded(x, width) for _, x in sorted(zip(saved["level"].to_pylist(), saved["body"].to_pylist(), strict=True))])
        for part in _batches(table):
            family.add(_entries(part, width))
        found = [(-1, c, x) for c, x in _answers(family, table["chunk"].to_pylist())]
        rows = [*found, *((k, key[0].as_py(), _dumped(x)) for k, x in enumerate(family.levels))]
        level, at, body = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"level": pa.array(level, pa.int32()), "at": pa.array(at, pa.int64()), "body": pa.array(body, pa.binary())})

    offered = d.groupBy("chunk").applyInArrow(lambda key, t: _offer(t, key[0].as_py(), width, buckets, None), SENT)
    both = save(offered.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(bucket, "level int, at long, body binary"), "family")
    levels = both.where("level >= 0").select(F.col("at").cast("int").alias("bucket"), F.lit(buckets).alias("buckets"), "level", "body")
    levels.write.parquet(f"{index}/{(versions or [0])[-1] + 1}")
    found = both.where("level < 0").select(F.col("at").alias("chunk"), "body")
    return times(d.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(lambda t, back: _finish(t, back, width), RESULT))
