"""Near-duplicate vectors by sorted projection passes.

A pass orders vectors by the bits of 63 random projections. A task holds a block of ``reach`` vectors in that order and the
next, and compares each vector of the block with all that follow. A vector goes on, tile by tile of two blocks, while the
vectors there share its first ``depth`` bits or links are found within the last ``window`` of them. So all pairs that share
these bits are compared, whatever lies between, and the number of passes follows from the depth and the recall asked for.
Equal vectors are one class first. Pairs verified in any pass are links; components unite them.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltwork.llm.common import components, discard, hot_bound, meet, save, tidied

BITS = 63
#: Vectors of a block compared at once.
STRIP = 512


def plan(n: int, least: float, reach: int, recall: float) -> tuple[int, int]:
    """Depth and passes for ``n`` vectors: a pair with a cosine of ``least`` is missed with a chance of 1 - ``recall`` at most.

    A bit is shared with a chance of 1 - angle / pi, whatever the other vectors are; a bucket of ``depth`` bits has
    ``reach`` vectors on average at most. At depth 0 one pass compares all pairs.
    """
    depth = max(0, math.ceil(math.log2(max(n, 1) / reach)))
    if depth == 0:
        return 0, 1
    miss = 1 - (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** depth
    return depth, 16 if miss <= 0 else max(16, math.ceil(math.log(1 - recall) / math.log(miss)))


def _matrix(column) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(a):
        return np.zeros((0, 1))
    v = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)
    return v / np.abs(v).max(axis=1)[:, None]  # the largest is 1, so that squares neither overflow nor vanish


def _keys(vectors: DataFrame, passes: int, seed: int, first: int = 0) -> DataFrame:
    """Keys of ``passes`` passes from ``first`` on."""

    def run(batches):
        planes = {}
        for b in batches:
            ids, dims = b.column(0), b.column(1).to_numpy()
            for dim in np.unique(dims):
                pick = pa.array(dims == dim)
                v = _matrix(b.column(2).filter(pick))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim), first] if first else [seed, int(dim)]).standard_normal((int(dim), passes * BITS))
                bits = (v @ planes[dim] > 0).reshape(len(v), passes, BITS)
                keys = bits.astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([ids.filter(pick), pa.array(dims[dims == dim], pa.int32()), pa.array(keys.tolist(), pa.list_(pa.int64()))], names=["id", "dim", "keys"])

    return vectors.select("id", "dim", "vector").mapInArrow(run, "id long, dim int, keys array<long>")


#: A link has ``pass`` -1; else ``a`` of block ``source``, in ``bucket``, has still to be compared with block ``next`` and on.
FOUND = "a long, b long, pass int, dim int, source long, next long, bucket long"


def _found(a: np.ndarray, b: np.ndarray, still: np.ndarray, bucket: np.ndarray, at: tuple[int, int, int, int]) -> pa.Table:
    n, m = len(a), len(still)
    cols = {"a": np.concatenate([np.minimum(a, b), still]), "b": np.concatenate([np.maximum(a, b), still])}
    cols |= {k: np.concatenate([np.full(n, -1), np.full(m, v)]) for k, v in zip(("pass", "dim", "source", "next"), at, strict=True)}
    cols["bucket"] = np.concatenate([np.full(n, -1), bucket])
    return pa.table({k: pa.array(v.astype(np.int64)).cast(pa.int32() if k in ("pass", "dim") else pa.int64()) for k, v in cols.items()})


def _unit(column) -> np.ndarray:
    v = _matrix(column)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _links(table: pa.Table, least: float, window: int, reach: int) -> pa.Table:
    """Pairs of one block; rows of the next block (``own`` false) only as later neighbours."""
    order = np.argsort(table["rank"].to_numpy())
    ids, own, bucket = (table[c].to_numpy()[order] for c in ("id", "own", "bucket"))
    v = _unit(table["vector"])[order]
    mine = np.count_nonzero(own)
    more = np.count_nonzero(~own) == reach  # else no block follows
    a, b, go = [], [], [np.zeros(0, bool)]
    for i in range(0, mine, STRIP):
        near = v[i : min(i + STRIP, mine)] @ v[i:].T >= least - 1e-9
        x, y = np.nonzero(np.triu(near, 1))
        hit = np.einsum("ij,ij->i", v[i + x], v[i + y]) >= least
        a.append(ids[i + x[hit]])
        b.append(ids[i + y[hit]])
        go.append(near[:, -window:].any(axis=1))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    go = np.flatnonzero((np.concatenate(go) | (bucket[:mine] == bucket[-1])) & more)
    block = table["block"][0].as_py()
    return _found(a, b, ids[go], bucket[go], (table["pass"][0].as_py(), table["dim"][0].as_py(), block, block + 2))


def _tile(table: pa.Table, least: float, window: int, reach: int) -> pa.Table:
    """Pairs of the vectors of one block that go on (``own``) with all of a later block."""
    own = table["own"].to_numpy()
    mine, theirs = table.filter(pa.array(own)), table.filter(pa.array(~own)).sort_by("rank")
    block = table["block"][0].as_py()
    at = (table["pass"][0].as_py(), table["dim"][0].as_py(), table["source"][0].as_py(), block + 1)
    none = np.zeros(0, np.int64)
    if not len(mine) or not len(theirs):
        return _found(none, none, none, none, at)
    hit = _unit(mine["vector"]) @ _unit(theirs["vector"]).T >= least
    i, j = np.nonzero(hit)
    ids, last, bucket = mine["id"].to_numpy(), mine["end"].to_numpy() == block + 1, mine["bucket"].to_numpy()
    go = last & (hit[:, -window:].any(axis=1) | (bucket == theirs["bucket"][-1].as_py())) if len(theirs) == reach else np.zeros(len(ids), bool)
    return _found(ids[i], theirs["id"].to_numpy()[j], ids[go], bucket[go], at)


def _go_on(found: DataFrame, places: DataFrame, vectors: DataFrame, least: float, window: int, reach: int) -> DataFrame:
    """All links, those of walks over more than two blocks included. Each round reaches twice as many blocks."""
    still = found.where("pass >= 0")
    if still.isEmpty():
        return found.where("pass < 0").select("a", "b")
    places, parts, width = save(places, "places"), [found], 1
    while not still.isEmpty():
        ask = still.select(F.col("a").alias("id"), "pass", "dim", "source", "bucket", (F.col("next") + width).alias("end"), F.explode(F.sequence("next", F.col("next") + (width - 1))).alias("block"))
        tiles = ask.select("pass", "dim", "source", "block").distinct()
        other = tiles.join(places, ["pass", "dim", "block"]).withColumn("own", F.lit(False)).withColumn("end", F.lit(None).cast("long"))
        rows = ask.withColumn("own", F.lit(True)).withColumn("rank", F.lit(None).cast("long")).unionByName(other).join(vectors, ["id", "dim"])
        part = save(rows.groupBy("pass", "dim", "source", "block").applyInArrow(lambda t: _tile(t, least, window, reach), FOUND), "tiles")
        parts.append(part)
        still, width = part.where("pass >= 0"), width * 2
    pairs = reduce(DataFrame.unionByName, parts).where("pass < 0 and a <> b").select("a", "b").distinct()
    links = save(pairs, "links")
    discard(places, *parts[1:])
    return links


def _pass_links(keys: DataFrame, vectors: DataFrame, shift: int, depth: int, least: float, window: int, reach: int) -> DataFrame:
    """Links of the passes in ``keys``, saved."""
    k = keys.withColumn("cell", F.shiftright("key", shift))
    counts = k.groupBy("pass", "dim", "cell").agg(F.count("*").alias("c"))
    w = Window.partitionBy("pass").orderBy("dim", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("pass", "dim", "cell", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("start"))
    r = k.withColumn("r", F.row_number().over(Window.partitionBy("pass", "dim", "cell").orderBy("key", "id"))).join(starts, ["pass", "dim", "cell"])
    r = r.withColumn("rank", F.col("start") + F.col("r") - 1).withColumn("block", F.floor(F.col("rank") / reach))
    places = r.select("id", "dim", "pass", "rank", "block", F.shiftright("key", BITS - depth).alias("bucket"))
    r = places.select("id", "dim", "pass", "rank", "bucket", F.explode(F.array(F.struct("block", F.lit(True).alias("own")), F.struct((F.col("block") - 1).alias("block"), F.lit(False).alias("own")))).alias("to")).where("to.block >= 0")
    rows = r.join(vectors.select("id", "vector"), "id").select("pass", "dim", "to.block", "to.own", "rank", "bucket", "id", "vector")
    found = rows.groupBy("pass", "dim", "block").applyInArrow(lambda t: _links(t, least, window, reach), FOUND)
    found = save(found.where("a <> b or pass >= 0").distinct(), "links")
    return _go_on(found, places, vectors, least, window, reach)


@tidied
def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.9, passes: int | None = None, window: int = 48, reach: int = 2048, seed: int = 7, recall: float = 0.999) -> DataFrame:
    """Per vector: ``vec_id, n_links, component_id, kept``.

    A link has a cosine of ``least`` or more in double precision; finite vectors of any length have one. Null, empty and zero
    vectors and vectors with null or non-finite components link with nothing, as do vectors of different dimensions. Unless
    ``passes`` is given, their number follows the number of vectors, so that each link is found with a chance of ``recall`` at
    least; all are found among up to ``reach`` vectors. Equal vectors (by 128 bits of hash) are a class of their own, whatever
    their ids, and a class counts each of its members. An empty
    table returns no rows; rows with a repeated id are vectors of their own; other columns are ignored. A null id comes after all
    others and is never kept.
    """
    d = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    fine = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    d = d.withColumn("fine", fine & ~F.coalesce(F.exists("vector", F.isnan), F.lit(False)))
    h1, h2 = F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector")
    keys = save(d.select("id", F.when(F.col("fine"), h1).alias("h1"), F.when(F.col("fine"), h2).alias("h2")), "ids")
    classes = d.where("fine").groupBy(h1.alias("h1"), h2.alias("h2")).agg(F.min("id").alias("rep"), F.count("*").alias("members"), F.any_value("vector").alias("vector"))
    # numbers are written once, so that they stay
    classes = save(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    vectors = classes.select(F.col("class").alias("id"), F.size("vector").alias("dim"), "vector")
    n = vectors.count()
    shift = BITS - max(4, min(20, int(n // 4096).bit_length() + 4))
    depth, enough = plan(n, least, reach, recall)
    passes = enough if passes is None else passes
    rounds = -(-passes // 16)  # no more than 16 passes are on disk at once
    cuts = [passes * i // rounds for i in range(rounds + 1)]
    parts = []
    for first, end in zip(cuts, cuts[1:], strict=False):
        k = save(_keys(vectors, end - first, seed, first).select("id", "dim", F.posexplode("keys").alias("pass", "key")), "keys")
        parts.append(_pass_links(k, vectors, shift, depth, least, window, reach))
        discard(k)
    links = parts[0] if rounds == 1 else save(reduce(DataFrame.unionByName, parts).distinct(), "links")
    bound = hot_bound(2 * links.count())
    labels = save(components(links), "labels")
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    other = ends.groupBy("other").agg(F.count("*").alias("n")).join(classes.select(F.col("class").alias("other"), "members"), "other")
    near = meet(ends, save(other, "members"), "other", bound).groupBy("id").agg(F.sum("members").alias("near"))
    named = classes.select("h1", "h2", F.col("class").alias("id"), "members", "rep").join(near, "id", "left").join(labels, "id", "left")
    named = save(named.withColumn("component", F.coalesce("component", "id")), "named")
    leads = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    named = meet(named, leads, "component", hot_bound(n))
    named = named.select("h1", "h2", (F.col("members") - 1 + F.coalesce("near", F.lit(0))).alias("links"), "component_id", F.col("members").alias("n"))
    out = meet(keys, save(named, "counts"), ["h1", "h2"], hot_bound(keys.count()), "left")
    component = F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
