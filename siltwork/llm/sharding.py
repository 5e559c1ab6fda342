"""Weighted rendezvous sharding of stable record keys. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork.llm.common import save

#: Hex digits of an md5 that become the uniform draw; 13 digits fit a double exactly.
_DIGITS = 13


def _draw(key: Column, shard: int, weight: float) -> Column:
    """Weighted rendezvous score of one shard: -weight / ln(u), u uniform in (0, 1) by key and shard."""
    n = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, _DIGITS), 16, 10).cast("double")
    return -F.lit(float(weight)) / F.log((n + 1) / F.lit(float(16**_DIGITS + 1)))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Index of the shard with the highest score for ``key``; equal scores go to the lower index.

    A shard that is added takes keys only into itself, one that is removed gives up only its own, and a
    shard's share follows its weight. A null key is the empty string. Depends on the key and weights only.
    """
    k = F.coalesce(key.cast("string"), F.lit(""))
    best = F.greatest(*[F.struct(_draw(k, i, w).alias("score"), F.lit(-i).alias("less")) for i, w in enumerate(weights)]) if len(weights) > 1 else None
    return F.lit(0) if best is None else -best["less"]


def assign(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """``df`` with an int column ``shard``; no shuffle."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    return df.withColumn(shard, rendezvous(F.col(key), weights).cast("int"))


def slots(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot", rows_per_cell: int = 200_000) -> DataFrame:
    """``df`` with a gapless number from 0 within each shard.

    Numbers are dealt in cells (a hash of ``order``): each cell is sorted on its own and starts where the
    cells before it end, so no task holds a whole shard however few shards there are. Rows equal in all of
    ``order`` get neighbouring numbers in any order; over ``rows_per_cell`` of them are spread over all cells.
    """
    cells = max(1, df.count() // rows_per_cell)
    key = F.xxhash64(*order)
    if cells > 1:
        # at most as many as there are cells
        often = [r[0] for r in df.groupBy(key.alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > rows_per_cell).collect()]
        if often:
            # written once, so that a row keeps its cell
            df = save(df.withColumn("__spread", F.when(key.isin(often), F.monotonically_increasing_id()).otherwise(0)), "spread")
            key = F.xxhash64(*order, "__spread")
    df = df.withColumn("__cell", F.pmod(key, F.lit(cells)).cast("int")).drop("__spread")
    counts = df.groupBy(shard, "__cell").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(shard).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "__cell", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))
    numbered = df.withColumn("__r", F.row_number().over(Window.partitionBy(shard, "__cell").orderBy(*order)))
    out = numbered.join(starts, [shard, "__cell"])
    return out.withColumn(slot, (F.col("__start") + F.col("__r") - 1).cast("long")).drop("__cell", "__r", "__start")


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Shard, slot, and the shard with one shard more, for every document, by ``key`` (the doc_id).

    Null text: size 8, crc of the empty string. Null doc_id: the empty key. Repeated rows share a shard and
    get slots of their own; an empty table returns no rows. Other columns are dropped here; :func:`assign` keeps them.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).cast("long").alias("text_crc32"))
    df = assign(df, "doc_id", [1.0] * n_shards)
    # one shard more competes with the winner only
    k = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    won = _draw_of(k, F.col("shard"))
    df = df.withColumn("grown_shard", F.when(_draw(k, n_shards, 1.0) > won, F.lit(n_shards)).otherwise(F.col("shard")).cast("int"))
    return slots(df, "shard", ["doc_id", "size", "text_crc32"]).withColumn("law", F.lit("key"))


def _draw_of(key: Column, shard: Column) -> Column:
    n = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, _DIGITS), 16, 10).cast("double")
    return -F.lit(1.0) / F.log((n + 1) / F.lit(float(16**_DIGITS + 1)))
