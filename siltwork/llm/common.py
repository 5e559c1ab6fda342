"""What the operators share: table access, saved tables, joins with hot keys, and components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.sources.store import discard, stored, tidied

save = stored
__all__ = ["NULL_ID", "bound_batches", "components", "discard", "hot_bound", "marked", "meet", "release_caches", "save", "table", "tidied", "tidy"]

#: Stands for a null doc_id where ids are ordered: after every other id.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows of texts and sketches are large: fewer travel to Python at once, unless the session sets how many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, rows)


def release_caches() -> None:
    """In a Python worker that served the packing before: give back its word cache."""
    packing = sys.modules.get("siltwork.llm.packing")
    if packing is not None:
        packing._CACHES.clear()


def tidy(cycles: bool = True) -> None:
    """At the end of a task: free memory goes back to the system, since Python workers outlive their tasks.

    Without ``cycles`` the garbage collector does not walk the heap, for tasks that make no cyclic garbage.
    """
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def meet(big: DataFrame, small: DataFrame, key: str | list[str], hot: int, how: str = "inner") -> DataFrame:
    """Equi join of ``big`` with ``small(key, n, ...)``, unique by ``key``; ``n``: rows of ``big`` with the key.

    Keys with more than ``hot`` rows are broadcast, so no task holds all rows of one; with ``hot`` a share of the rows of
    ``big``, they are few. The others are joined as Spark sees fit. ``n`` is dropped.
    """
    often = small.where(F.col("n") > hot).drop("n").withColumn("__hot", F.lit(True))
    d = big.join(F.broadcast(often), key, "left")
    found = d.where("__hot").drop("__hot")
    rest = d.where("__hot is null").select(big.columns).join(small.where(F.col("n") <= hot).drop("n"), key, how)
    return found.unionByName(rest)


#: A key is hot with over this many rows, or more where over so many keys (a few MB) would be hot.
HOT_ROWS, HOT_KEYS = 1000, 100_000


def hot_bound(rows: int) -> int:
    return max(HOT_ROWS, rows // HOT_KEYS)


#: Words of 64 bits in a filter of keys, at most (some 50 MB where it is broadcast). Beyond four keys a word it tells less, never wrongly.
MARK_WORDS = 1 << 19


def marked(big: DataFrame, key: list[Column], keys: DataFrame, n: int, marks: int = MARK_WORDS) -> DataFrame:
    """``big`` with a boolean ``__may``: false where ``key`` surely equals no row of ``keys``, of which there are about ``n``.

    A join that follows shuffles wide rows only where it holds, whatever the number of keys: with up to four keys in each of ``marks`` words it
    holds for some 2 % of other rows. ``keys`` is read once; equal keys have equal types.
    """
    words = min(max(n // 4, 1), marks)
    where, bits = f"pmod(__h, {words}L)", "shiftleft(1L, cast(shiftrightunsigned(__h, 58) as int)) | shiftleft(1L, cast(shiftrightunsigned(__h, 52) & 63 as int))"
    told = keys.select(F.xxhash64(*keys.columns).alias("__h")).select(F.expr(where).alias("__word"), F.expr(bits).alias("__bits")).groupBy("__word").agg(F.bit_or("__bits").alias("__told"))
    d = big.withColumn("__h", F.xxhash64(*key)).withColumn("__word", F.expr(where)).join(F.broadcast(told), "__word", "left")
    return d.withColumn("__may", F.expr(f"coalesce((__told & ({bits})) = ({bits}), false)")).select(*(d[c] for c in big.columns), "__may")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long): ``(id, component)`` with the smallest id reachable.

    Alternates large-star and small-star rounds, each a partial aggregation and an equi join; the minimum of an
    id with very many edges is broadcast, so that no task gets all of them. Ids without an edge do not appear. An empty table
    gives no rows; rounds that do not settle raise.
    """
    e = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen, n = None, e.count()
    for _ in range(max_rounds):
        hot = hot_bound(2 * n)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "low")
        large = meet(both.where("v > u"), low, "u", hot).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = save(large.unionByName(low.where("u > m").select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "large")
        below = save(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "below")
        small = meet(large, below, "u", hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, save(small.unionByName(below.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        discard(last, low, large, below)
        # a star forest is the fixed point: no end of an edge is the start of another
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        n = now["n"]
        if (n, now["h"]) == seen:
            break
        seen = (n, now["h"])
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = e.groupBy("v").agg(F.lit(1).alias("one")).select(F.col("v").alias("id"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
