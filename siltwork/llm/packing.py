"""Best-fit packing by minimum bin slack over the lengths of pieces.

The packing runs on the histogram of lengths, which has at most ``capacity`` entries however many
documents there are; pieces meet their places by an equi join.
"""

from __future__ import annotations

import os
import string
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltwork.llm.common import bound_batches, save, tidy

_PUNCTUATION = string.punctuation.encode()
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, as often as they occur at most, whose sum is the greatest that is at most ``room``.

    Subset sums are bits of one integer; after each length the state is kept, to walk back.
    """
    full = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left > 0:
            take = min(step, left)
            new = reach | (reach << (take * length)) & full
            if new != reach:
                trail.append((reach, length, take))
                reach = new
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for before, length, take in reversed(trail):
        if not before >> total & 1:
            out += [length] * take
            total -= take * length
    return out


def minimum_slack(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many such bins). The longest piece left opens a bin, the fullest combination
    of the others joins it, and the same bin is repeated while its lengths last."""
    left = {k: v for k, v in histogram.items() if v > 0}
    bins = []
    while left:
        top = max(left)
        left[top] -= 1
        chosen = [top, *fullest(left, capacity - top)]
        left[top] += 1
        need = {x: chosen.count(x) for x in set(chosen)}
        times = min(left[x] // n for x, n in need.items())
        bins.append((chosen, times))
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return bins


class WordCache:
    """Ids of a text, by the ids of its words: the tokenizer never joins across white space.

    A word that ends in ASCII punctuation is its head and the punctuation, which the tokenizer splits as well; heads of
    letters alone are encoded many at a time and told apart by the end-of-word mark of their last token.
    Beyond ``most`` words those that were not met again go, since most words of a corpus occur once: half of ``most`` stay at most.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads would spin
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self):
        self.known, self.flat, self.at, self.again = {}, array("I"), array("q", [0]), bytearray()

    def add(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        """``ids`` of all ``words``, and where those of each end."""
        self.known.update(zip(words, range(len(self.at) - 1, len(self.at) - 1 + len(words)), strict=True))
        self.at.frombytes((ends + self.at[-1]).astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(np.uint32).tobytes())
        self.again.extend(bytes(len(words)))

    def shrink(self) -> None:
        """Keep what was met again since the last time, the oldest first; numbers change."""
        words, kept = list(self.known), np.flatnonzero(np.frombuffer(self.again, np.uint8))[: self.most // 2]
        ids, ends = self.gather(kept)
        self.clear()
        self.add([words[i] for i in kept.tolist()], ids, ends)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))

    def gather(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by their numbers, and where those of each end."""
        flat, at = np.frombuffer(self.flat or array("I", [0]), np.uint32), np.frombuffer(self.at, np.int64)
        n = at[k + 1] - at[k]
        end = np.cumsum(n)
        return flat[np.repeat(at[k] - end + n, n) + np.arange(end[-1] if len(end) else 0)], end

    def learn(self, words: set[bytes]) -> None:
        split, alone = [], []
        for w in words:
            head = w.rstrip(_PUNCTUATION)
            if head and len(head) < len(w) and 97 <= head[-1] <= 122 and b"<|" not in w:
                split.append((w, head, w[len(head) :]))
            else:
                alone.append(w)
        fresh = {x for _, h, t in split for x in (h, t)}.union(alone).difference(self.known)
        letters, other = [], []
        for w in sorted(fresh):
            (letters if w.decode().isalpha() else other).append(w)
        for i in range(0, len(letters), 5000):
            part = letters[i : i + 5000]
            ids = np.array(self.tok.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) == len(part) and end[-1] == len(ids):
                self.add(part, ids, end)
            else:
                other += part
        for i in range(0, len(other), 1000):  # encodings are far larger than their ids
            part = other[i : i + 1000]
            ids = [e.ids for e in self.tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)]
            self.add(part, np.fromiter(chain.from_iterable(ids), np.uint32), np.cumsum([len(x) for x in ids]))
        ids, ends = self.gather(np.array([self.known[x] for _, h, t in split for x in (h, t)], np.int64))
        self.add([w for w, _, _ in split], ids, ends[1::2])

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        # ASCII is lowered here already, unless a combining mark could compose differently or a special token arise then
        words = [(t if b"\xcc" in t or b"\xcd" in t or b"<|" in t else t.lower()).split() for t in texts]
        flat = list(chain.from_iterable(words))
        k = self.numbers(flat)
        np.frombuffer(self.again or bytearray(1), np.uint8)[k[k >= 0]] = 1
        missing = np.flatnonzero(k < 0).tolist()
        if missing:
            new = {flat[i] for i in missing}
            if len(self.known) + len(new) > self.most:
                self.shrink()
                k = self.numbers(flat)
                missing = np.flatnonzero(k < 0).tolist()
                new = {flat[i] for i in missing}
            self.learn(new)
            k[missing] = [self.known[flat[i]] for i in missing]
        ids, end = self.gather(k)
        return np.split(ids, np.r_[0, end][np.cumsum([len(w) for w in words])[:-1]])


_CACHES: dict[str, WordCache] = {}


def _cache(path: str | None) -> WordCache:
    """One cache for each Python worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Texts by somewhat under a MB, a long one alone: lists of words take many times their bytes."""
    size, part = 0, ([], [])
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            part[0].append(i)
            part[1].append(t.as_py() or b"")
            size += len(part[1][-1])
            if size > 700_000:
                yield part
                size, part = 0, ([], [])
    if part[0]:
        yield part


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of every document: its ids, then ``end_id``, cut every ``capacity`` ids. Null text is empty."""

    def run(batches):
        cache = _cache(tokenizer)
        for doc_ids, texts in _batches(batches):
            rows = []
            for d, ids in zip(doc_ids, cache.ids(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for p in range(0, len(ids), capacity):
                    x = ids[p : p + capacity]
                    rows.append((d, p // capacity, p, len(x), zlib.crc32(x.tobytes())))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        tidy(cycles=False)

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, PIECES)


def place(parts: DataFrame, capacity: int = 2048, rows_per_cell: int = 50_000) -> DataFrame:
    """``parts`` (with ``length``, and ``doc_id``, ``piece`` and ``row``, a number of its own, as order) with ``sequence_id`` and ``offset``.

    Pieces of one length are numbered in cells, so that a very common length is not sorted in one task. The
    places of a length are ranges of these numbers, as many as ``capacity`` bounds.
    """
    spark = parts.sparkSession
    found = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    cells = max(1, sum(found.values()) // rows_per_cell)
    parts = parts.withColumn("__cell", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(cells)).cast("int"))
    counts = parts.groupBy("length", "__cell").agg(F.count("*").alias("__n"))
    w = Window.partitionBy("length").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "__cell", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))
    ranked = parts.withColumn("__r", F.row_number().over(Window.partitionBy("length", "__cell").orderBy("doc_id", "piece", "row")))
    ranked = ranked.join(starts, ["length", "__cell"]).withColumn("__rank", F.col("__start") + F.col("__r") - 1)
    rows, next_rank, sequence = [], {}, 0
    for chosen, times in minimum_slack(found, capacity):
        offset = 0
        for x, c in Counter(chosen).items():
            at = next_rank.get(x, 0)
            next_rank[x] = at + times * c
            rows.append((x, at, at + times * c, c, sequence, offset))
            offset += x * c
        sequence += times
    places = spark.createDataFrame(rows, "length long, __from long, __to long, __each long, __sequence long, __offset long")
    # each bin uses a length up, and its lengths differ: some sqrt(2 * capacity) of them, so there are at most capacity * sqrt(2 * capacity)
    # rows of 48 bytes, 6 MB at a capacity of 2048; the hash join is on the length, where a few ranges stand for all ranks
    out = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))).drop(places["length"])
    k = F.col("__rank") - F.col("__from")
    out = out.withColumn("sequence_id", F.col("__sequence") + F.floor(k / F.col("__each"))).withColumn("offset", F.col("__offset") + F.pmod(k, F.col("__each")) * F.col("length"))
    return out.drop("__cell", "__start", "__r", "__rank", "__from", "__to", "__each", "__sequence", "__offset")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048) -> DataFrame:
    """Pieces of all documents with their places: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Empty table: no rows. Null and empty texts: a piece of the end id alone. Repeated rows are packed each.
    """
    # rows are numbered once, so that repeated ones spread over cells too
    parts = save(pieces(docs, tokenizer, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return place(parts, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
