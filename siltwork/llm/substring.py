"""Repeated word passages by fixed-block anchors.

Every document is cut into non-overlapping blocks of ``width // 2`` words, the reference blocks: any window
of ``width`` words holds one whole. Every rolling window of that many words probes them. Where a probe
hits, the repeat is extended, window by window: all ``width``-word windows over the hit are compared by a 128-bit fingerprint
of their whole word sequence, and the union of the windows that also start in a smaller document, which is every
maximal exact repeat of ``width`` words or more, is removed. Windows over no hit are never compared.

Documents travel in chunks of a few MB (a hash of the row); hashes go to buckets of the hash space, as one sorted
set for each chunk and bucket. A passage that a third of all documents share is thus one entry for each
chunk, and no step holds more than a chunk or bucket. Chunks are joined with what came back by chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siltwork.llm.bytehash import U, Words, blocks, by_bucket, column_bytes, in_sorted, packed, unpacked
from siltwork.llm.common import NULL_ID, save

_BITS = 43
SENT = "bucket int, chunk long, body binary"


def in_chunks(docs: DataFrame, chunk_bytes: int = 4 << 20, copies: int = 1, least: int = 16) -> tuple[DataFrame, int]:
    """``chunk, doc_id, ord, text, times`` with rows dealt into chunks; and how many chunks. ``ord``: the id to compare.

    There are ``least`` chunks at least, where these still have 64 KB. Rows that repeat in id and text are reduced
    to ``copies`` rows; ``times`` says how many rows each stands for, so that no chunk gets all of very many such rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.withColumn("ord", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("h", F.xxhash64("text"))
    seen = Observation()
    keys = d.groupBy("ord", "h").agg(F.count("*").alias("times"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).observe(seen, F.sum("bytes").alias("bytes"))
    again = save(keys.where("times > 1").select("ord", "h", "times"), "again")
    size = seen.get["bytes"] or 0
    n = max(1, size // chunk_bytes, min(least, size >> 16))
    if again.isEmpty():
        d = d.withColumn("times", F.lit(1).cast("long")).withColumn("copy", F.lit(0))
    else:
        once = d.join(again, ["ord", "h"], "left_anti").withColumn("times", F.lit(1).cast("long")).withColumn("copy", F.lit(0))
        many = d.join(again, ["ord", "h"]).dropDuplicates(["ord", "h"])
        many = many.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        many = many.withColumn("times", F.when(F.col("copy") == 0, F.col("times") - (copies - 1)).otherwise(1).cast("long"))
        d = once.unionByName(many.select(once.columns))
    d = d.select(F.pmod(F.xxhash64("ord", "h", "copy"), F.lit(n)).alias("chunk"), "doc_id", "ord", "text", "times")
    return d.repartition("chunk"), n


def times(out: DataFrame) -> DataFrame:
    """Each row as often as its ``times`` says."""
    return out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")


def sent(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    b, c, x = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"bucket": pa.array(b, pa.int32()), "chunk": pa.array(c, pa.int64()), "body": pa.array(x, pa.binary())})


def answers(rows: list[tuple[int, bytes]]) -> pa.Table:
    c, x = zip(*rows, strict=True) if rows else ((), ())
    return pa.table({"chunk": pa.array(c, pa.int64()), "body": pa.array(x, pa.binary())})


def live(table: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk, its hashes that at least two places hold and one holds as a mark.

    An entry is ``hash << 1 | mark`` and occurs once a chunk and mark.
    """
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
    marked = np.add.reduceat((v & U(1)).astype(np.int64), first) > 0
    ok = np.repeat((n > 1) & marked, n)
    h, who = h[ok], who[ok]
    order = np.argsort(who, kind="stable")
    h, who = h[order], who[order]
    at = np.searchsorted(who, np.arange(len(chunks) + 1))
    return answers([(c, packed(h[a:b])) for c, a, b in zip(chunks, at[:-1], at[1:], strict=True) if b > a])


def _merged(table: pa.Table) -> np.ndarray:
    parts = [unpacked(x.as_py()) for x in table["body"]]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, U)


def classes(f: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal 128-bit values ``f, g`` together, and where each of them begins in it."""
    order = np.argsort(f, kind="stable")
    x, y = f[order], g[order]
    if len(x) and ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():
        order = np.lexsort((g, f))
        x, y = f[order], g[order]
    return order, np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, np.int64)


def place_of(f: np.ndarray, g: np.ndarray, known_f: np.ndarray, known_g: np.ndarray) -> np.ndarray:
    """Where each 128-bit value is in the known ones, sorted by ``known_f``; -1 where it is not."""
    out = np.full(len(f), -1)
    if not len(known_f):
        return out
    at, last = np.searchsorted(known_f, f), len(known_f) - 1
    left = np.flatnonzero(known_f[np.minimum(at, last)] == f)
    while len(left):  # once, unless known values agree in their first half
        here = at[left]
        ok = known_g[here] == g[left]
        out[left[ok]] = here[ok]
        left = left[~ok]
        at[left] += 1
        left = left[(at[left] <= last) & (known_f[np.minimum(at[left], last)] == f[left])]
    return out


def remove_repeats(docs: DataFrame, width: int = 50, chunk_bytes: int = 4 << 20) -> DataFrame:
    """Per document: ``doc_id, text, n_words, n_removed, kept`` (its kept words joined by one space).

    A word goes when a window of ``width`` words that covers it also starts in a document with a smaller
    doc_id, judged on the input. Null and empty texts have no words; documents under ``width`` words stay. Rows with
    the same doc_id count as one document; a null doc_id comes after all others. Repeated rows return one
    row each; an empty table returns none; other columns are ignored. ``chunk_bytes`` bounds what a task holds; the
    result does not depend on it.
    """
    block = width // 2
    d, n = in_chunks(docs, chunk_bytes)
    n_buckets = max(1, n // 2)

    def anchors(table):
        """Sorted ``hash << 1 | is a reference block`` of all probes, and whether two documents hold it."""
        data, off = column_bytes(table["text"])
        ids = table["ord"].to_numpy()
        keys, owners = [], []
        for i, j in blocks(off):
            w = Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            at, h = w.rolling(block)
            doc = np.searchsorted(w.first, at, "right") - 1
            mark = (at - w.first[doc]) % block == 0
            keys.append((h >> U(64 - _BITS)) << U(1) | mark.astype(U))
            owners.append(ids[i + doc])
        return np.concatenate(keys or [np.zeros(0, U)]), np.concatenate(owners or [np.zeros(0, np.int64)])

    def probe(key, table):
        chunk = key[0].as_py()
        v = np.unique(anchors(table)[0])
        twice = np.r_[v[1:] >> U(1) == v[:-1] >> U(1), False] if len(v) else np.zeros(0, bool)
        v = v[~twice]  # the marked entry stands for the other
        return sent([(b, chunk, packed(v[x:y])) for b, x, y in by_bucket(v, _BITS + 1, n_buckets)])

    def windows(table):
        """Of all windows: fingerprint in two halves, document's row, start word in the chunk."""
        data, off = column_bytes(table["text"])
        fs, gs, rows, starts, base = [], [], [], [], 0
        for i, j in blocks(off):
            w = Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            at, f, g = w.rolling128(width)
            fs.append(f)
            gs.append(g)
            rows.append(i + np.searchsorted(w.first, at, "right") - 1)
            starts.append(at + base)
            base += len(w.hash)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return cat(fs, U), cat(gs, U), cat(rows, np.int64), cat(starts, np.int64)

    def hit_windows(table, known):
        """Which windows, as by :func:`windows`, cover a whole anchor that other places hold."""
        data, off = column_bytes(table["text"])
        key, owner = anchors(table)
        h = key >> U(1)
        order = np.lexsort((owner, h))
        hs, os, ms = h[order], owner[order], (key[order] & U(1)).astype(np.int64)
        local = np.zeros(len(h), bool)
        if len(hs):
            first = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
            size = np.diff(np.r_[first, len(hs)])
            several = (np.minimum.reduceat(os, first) < np.maximum.reduceat(os, first)) & (np.add.reduceat(ms, first) > 0)
            local[order] = np.repeat(several, size)
        hit = local | in_sorted(h, known)
        out, k = [], 0
        for i, j in blocks(off):
            w = Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            at, _ = w.rolling(block)
            mine = hit[k : k + len(at)]
            k += len(at)
            count = np.zeros(len(w.hash) + 1, np.int64)
            count[1:][at[mine]] = 1
            count = np.cumsum(count)
            s, _ = w.rolling(width)
            out.append(count[s + width - block + 1] - count[s] > 0)
        return np.concatenate(out or [np.zeros(0, bool)])

    def extend(key, table, back):
        """Windows over a hit, each once: its smallest document here, and whether others here hold it too."""
        chunk = key[0].as_py()
        if not table.num_rows:
            return sent([])
        take = hit_windows(table, _merged(back))
        f, g, row, _ = windows(table)
        f, g, ids = f[take], g[take], table["ord"].to_numpy()[row[take]]
        order, first = classes(f, g)
        if not len(first):
            return sent([])
        low, high = np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)
        f, g, more = f[order][first], g[order][first], low < high
        return sent([(b, chunk, f[x:y].tobytes() + g[x:y].tobytes() + low[x:y].tobytes() + more[x:y].tobytes()) for b, x, y in by_bucket(f, 64, n_buckets)])

    def smallest(key, table):
        """For each chunk: fingerprints that documents of it share with a smaller one, and the smallest."""
        chunks, bodies = table["chunk"].to_pylist(), [x.as_py() for x in table["body"]]
        if not bodies:
            return answers([])
        n = [len(x) // 25 for x in bodies]
        f, g, ids = (np.concatenate([np.frombuffer(x, t, k, 8 * k * i) for x, k in zip(bodies, n, strict=True)]) for i, t in enumerate((U, U, np.int64)))
        more = np.concatenate([np.frombuffer(x, bool, k, 24 * k) for x, k in zip(bodies, n, strict=True)])
        who = np.repeat(np.arange(len(bodies)), n)
        order, first = classes(f, g)
        f, g, ids, more, who = (x[order] for x in (f, g, ids, more, who))
        low = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.r_[first, len(f)]))
        ok = (low < ids) | more
        f, g, low, who = f[ok], g[ok], low[ok], who[ok]
        order = np.lexsort((f, who))
        f, g, low, who = f[order], g[order], low[order], who[order]
        at = np.searchsorted(who, np.arange(len(chunks) + 1))
        return answers([(c, f[a:b].tobytes() + g[a:b].tobytes() + low[a:b].tobytes()) for c, a, b in zip(chunks, at[:-1], at[1:], strict=True) if b > a])

    def finish(table, back):
        data, off = column_bytes(table["text"])
        ids = table["ord"].to_numpy()
        bodies = [x.as_py() for x in back["body"]]
        gone = np.zeros(0, np.int64)
        if bodies and table.num_rows:
            f, g, row, start = windows(table)
            p, q, k = (np.concatenate([np.frombuffer(x, t, len(x) // 24, len(x) // 3 * i) for x in bodies]) for i, t in enumerate((U, U, np.int64)))
            order = np.argsort(p, kind="stable")
            p, q, k = p[order], q[order], k[order]
            at = place_of(f, g, p, q)
            gone = start[(at >= 0) & (k[at] < ids[row])]
        base, n_words, n_removed, kept = 0, [], [], []
        for i, j in blocks(off):
            o = off[i : j + 1] - off[i]
            block_data = data[off[i] : off[j]]
            w = Words(block_data, o)
            m = len(w.hash)
            here = gone[np.searchsorted(gone, base) : np.searchsorted(gone, base + m)] - base
            base += m
            depth = np.zeros(m + width + 1, np.int32)
            np.add.at(depth, here, 1)
            np.subtract.at(depth, here + width, 1)
            keep = np.cumsum(depth)[:m] == 0
            total = np.r_[0, np.cumsum(keep)]
            n_words += w.count.tolist()
            n_removed += (w.count - (total[w.first[1:]] - total[w.first[:-1]])).tolist()
            # the bytes of kept words, and one space after each where there is white space
            flags = np.zeros(len(block_data) + 1, bool)
            word = np.cumsum(w.begins) - 1
            inside = w.inside & (keep[np.maximum(word, 0)] if m else False)
            flags[:-1] = inside
            tail = w.end[keep]
            flags[tail[tail < len(block_data)]] = True
            flags[o[1:-1]] = inside[np.minimum(o[1:-1], len(block_data) - 1)] if len(block_data) else False
            flags[-1] = False
            flags = flags[:-1]
            text = np.where(w.inside, block_data, np.uint8(32))
            sums = np.r_[0, np.cumsum(flags)]
            text = text[flags].tobytes()
            kept += [text[a:b].strip(b" ") for a, b in zip(sums[o[:-1]].tolist(), sums[o[1:]].tolist(), strict=True)]
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()), "times": table["times"]})

    hits = d.groupBy("chunk").applyInArrow(probe, SENT).groupBy("bucket").applyInArrow(live, "chunk long, body binary")
    more = d.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extend, SENT)
    low = more.groupBy("bucket").applyInArrow(smallest, "chunk long, body binary")
    out = "doc_id long, n_words long, n_removed long, kept binary, times long"
    return times(d.groupBy("chunk").cogroup(low.groupBy("chunk")).applyInArrow(finish, out))
