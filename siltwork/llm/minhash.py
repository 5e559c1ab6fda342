"""Near duplicates by bottom-k sketches of word shingles.

1. Each text gives its set of shingles (64-bit hashes) by one hash function, the ``k`` smallest as its sketch, and a
   128-bit hash of the set. Equal sets are one class from there on, with a number of its own, whatever ids its rows have.
2. Inverted lists of retained values. Two sets that are similar enough share at least ``_need`` retained
   values (surely where sketches are whole sets, else up to about 1e-10), so of each sketch only a prefix must
   be listed. In the prefix order, values that very many classes retain come last.
3. Round one compares each member of a list with one hub, linear in the list. Components follow. Round two
   takes the lists that still hold several components: their pairs across components, in blocks where a list is long.
4. A pair must reach the overlap, then the estimate on the union's sketch (first on a few values, then on all, less five
   standard deviations); what is left is decided by exact Jaccard similarity on full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.bytehash import U, Words, blocks, column_bytes, mix
from siltwork.llm.common import NULL_ID, bound_batches, components, discard, hot_bound, marked, meet, release_caches, save, tidied, tidy

#: Lists up to this length give their pairs in SQL; blocks of longer lists have this many members.
SMALL, BLOCK = 16, 2048


def shingle_sets(table, width: int):
    """Of each row of a batch: sorted distinct shingle hashes of its lower-cased words."""
    data, off = column_bytes(table)
    for i, j in blocks(off):
        w = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
        at, h = w.rolling(width)
        whole = w.whole(width)
        cut = np.searchsorted(at, w.first)
        for r in range(j - i):
            if w.count[r] >= width:
                yield np.unique(h[cut[r] : cut[r + 1]])
            else:
                yield whole[r : r + 1] if w.count[r] else np.zeros(0, U)


#: Retained values travel as their upper 40 bits, 5 bytes each; exact verification uses all 64.
_CUT = U(24)


def _sketch(s: np.ndarray, k: int) -> bytes:
    v = np.unique(s[:k] >> _CUT)
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _values(sketch: bytes) -> np.ndarray:
    out = np.zeros((len(sketch) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(sketch, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(U)


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    return int(s.sum(dtype=U)) - 2**63, int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)) - 2**63


def _sketches(docs: DataFrame, k: int, width: int) -> DataFrame:
    """``id, text_hash, size, hi, lo, sketch`` of every row."""

    def run(batches):
        release_caches()
        for b in batches:
            rows = [(len(s), *_set_hash(s), _sketch(s, k)) for s in shingle_sets(b.column(2), width)]
            c = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["id", "text_hash", "size", "hi", "lo", "sketch"])
        tidy()

    return _keyed(docs).mapInArrow(run, "id long, text_hash long, size long, hi long, lo long, sketch binary")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _need(n: int, k: int, share: float) -> int:
    """Retained values that a set of ``n`` has in common with any similar set, at least."""
    if n <= share * k:
        return math.ceil(share * n - 1e-9)
    return max(1, math.floor(share * k - 6.5 * math.sqrt(k * share * (1 - share))))


def _broadcast(reps: DataFrame, hot: dict[int, int]):
    """Common values with their counts, two sorted arrays; some MB."""
    keys = np.array(sorted(hot), dtype=np.int64)
    return reps.sparkSession.sparkContext.broadcast((keys, np.array([hot[x] for x in keys.tolist()], dtype=np.int64)))


def _prefix(sketch: bytes, n: int, k: int, share: float, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The values that a sketch is listed under: very common ones come last."""
    v, (keys, n_of) = _values(sketch).view(np.int64), hot
    if not len(v):
        return v
    p = len(v) - min(_need(n, k, share), len(v)) + 1
    if not len(keys):
        return v[:p]
    at = np.minimum(np.searchsorted(keys, v), len(keys) - 1)
    return v[np.argsort(np.where(keys[at] == v, n_of[at], 0), kind="stable")[:p]]


def _listed(reps: DataFrame, k: int, share: float, known) -> DataFrame:
    """``value, id, m``: the prefix of each sketch, with the size of the set."""

    def run(batches):
        hot = known.value
        for b in batches:
            ids, sizes = b.column(0).to_numpy(), b.column(1).to_numpy()
            got = [_prefix(s, n, k, share, hot) for n, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            values = np.concatenate(got) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), *(pa.array(np.repeat(x, [len(g) for g in got]), pa.int64()) for x in (ids, sizes))], names=["value", "id", "m"])
        tidy()

    return reps.select("id", "n", "sketch").mapInArrow(run, "value long, id long, m long")


#: Retained values that a first look at a pair takes, and how many must be common: similar sets of a share of 0.8 have fewer with a
#: chance of about 1e-10.
LOOK, COMMON = 24, 5


def _tested(pairs: DataFrame, reps: DataFrame, share: float, test) -> DataFrame:
    """The pairs whose sizes allow the share and whose sketches pass ``test(n, m, x, y)``."""

    def run(batches):
        for b in batches:
            ok = [test(n, m, _values(s), _values(t)) for n, m, s, t in zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))
        tidy()

    x = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    y = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    joined = pairs.join(x, "a").join(y, "b").where(_sizes_allow(F.col("na"), F.col("nb"), share))
    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _estimated(pairs: DataFrame, reps: DataFrame, k: int, share: float) -> DataFrame:
    """The pairs whose union's sketch leaves the share possible. Pairs by chance go at a first look at a few values, so that whole
    sketches travel for the others only."""

    def look(n, m, x, y):
        union = np.union1d(x, y)[:LOOK]
        return len(union) < LOOK or share < 0.8 or len(np.intersect1d(np.intersect1d(x, y, True), union, True)) >= COMMON

    floor = share - 5 * math.sqrt(share * (1 - share) / k)

    def whole(n, m, x, y):
        union = np.union1d(x, y)
        if n > k or m > k:
            union = union[:k]
        both = len(np.intersect1d(np.intersect1d(x, y, True), union, True))
        return both + 1 >= (floor if n > k or m > k else share) * len(union)

    short = reps.select("id", "n", F.substring("sketch", 1, 5 * LOOK).alias("sketch"))
    near = save(_tested(pairs, short, share, look), "looked")
    ids = near.select(F.explode(F.array("a", "b")).alias("id"))
    some = marked(reps, [F.col("id")], ids, 2 * near.count()).where("__may").drop("__may")
    return _tested(near, some.join(ids.distinct(), "id", "left_semi"), share, whole)


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on full sets, saved."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = save(reps.join(ids, "id", "left_semi").select(F.col("id").alias("class"), "first.id", "first.text_hash"), "classes")    # ids alone first, so that Spark broadcasts them while they are few, and the texts are not shuffled
    some = save(ids.select("id").distinct(), "ids")

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.tobytes() for s in shingle_sets(b.column(2), width)], pa.binary())], names=["id", "text_hash", "s"])
        tidy()

    texts = marked(_keyed(docs), [F.col("id")], some, some.count()).where("__may").drop("__may")  # many ids: other texts are not shuffled either
    saved = save(texts.join(some, "id", "left_semi").mapInArrow(sets, "id long, text_hash long, s binary"), "full")
    # rows that repeat a text once; then other texts with these ids go
    full = saved.dropDuplicates(["id", "text_hash"]).join(ids, ["id", "text_hash"]).select(F.col("class").alias("id"), "s")

    def run(batches):
        for b in batches:
            ok = []
            for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(s, U), np.frombuffer(t, U)
                both = len(np.intersect1d(x, y, True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))
        tidy()

    joined = pairs.join(full.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(full.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    out = save(joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "links")
    discard(ids, some, saved)
    return out


def _sizes_allow(x, y, share: float):
    return F.least(x, y) >= F.greatest(x, y) * share - 1e-6


def _overlap(n: np.ndarray, m: np.ndarray, k: int, share: float) -> np.ndarray:
    """Retained values that similar sets of these sizes have in common: exact for whole sets, else less 5.5 deviations."""
    low, high = np.minimum(n, m), np.maximum(n, m)
    part = np.minimum(share * (1 + low / high) / (1 + share), 1)
    kept = np.minimum(high, k)
    least = np.where(high <= k, share * (n + m) / (1 + share) - 1, kept * part - 5.5 * np.sqrt(kept * part * (1 - part)) - 1)
    return np.where(low >= share * high - 1e-6, least, np.inf)


def _groups(many: DataFrame, bound: int) -> DataFrame:
    """``value, together, id, label, n`` from lists of ``value, id, label, n, hub``: those of a hub as one group of ``n`` members under its id
    where it has no more pairs than they have, the others as they are."""
    members = save(many.groupBy("hub", "id").agg(F.min("label").alias("label"), F.sum("n").alias("pairs"), F.count("*").alias("rows")), "by_hub")
    hubs = members.groupBy("hub").agg(F.count("*").alias("size"), F.sum("pairs").alias("pairs"), F.sum("rows").alias("rows"))
    hubs = save(hubs.select("hub", "size", "rows", (F.col("size") * F.col("size") <= F.col("pairs")).alias("one")), "hubs_of_long")
    one = meet(members, hubs.where("one").select("hub", F.col("size").alias("n"), "size"), "hub", bound)
    rest = meet(many, hubs.where("not one").select("hub", F.col("rows").alias("n")), "hub", bound)
    one = one.select(F.col("hub").alias("value"), F.lit(True).alias("together"), "id", "label", F.col("size").alias("n"))
    return one.unionByName(rest.select("value", F.lit(False).alias("together"), "id", "label", "n"))


def _across(lists: DataFrame, reps: DataFrame, k: int, share: float, known, bound: int) -> DataFrame:
    """Pairs of different components in lists of ``value, id, label, n, m, hub`` with enough common retained values.

    Long lists with the same hub, mostly those of one passage, are one group, unless that makes more pairs than the lists
    have: each sketch then travels once a group. Of other long lists a pair comes from the first that both are in.
    """
    few = lists.where(F.col("n") <= SMALL).groupBy("value").agg(F.collect_list(F.struct("id", "label", "m")).alias("l"))  # at most SMALL
    x, y = F.col("x"), F.col("y")
    few = few.select(F.explode("l").alias("x"), "l").select("x", F.explode("l").alias("y")).where((x["id"] < y["id"]) & (x["label"] != y["label"]) & _sizes_allow(x["m"], y["m"], share)).select(x["id"].alias("a"), y["id"].alias("b"))

    def common(values: list[np.ndarray], rows: np.ndarray, cols: np.ndarray):
        """Function of a part of ``rows``: how many values each has in common with each of ``cols``."""
        u, code, n = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(values)), [len(v) for v in values])
        shared = np.flatnonzero(n > 1)
        new = np.full(len(u), -1)
        new[shared] = np.arange(len(shared))
        code = new[code]
        owner, code = owner[code >= 0], code[code >= 0]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]

        def of(part: np.ndarray) -> np.ndarray:
            total = np.zeros((len(part), len(cols)), np.float32)
            for at in range(0, len(shared), 2048):  # some columns at a time
                x, y = np.searchsorted(code, [at, at + 2048])
                m = np.zeros((len(values), 2048), np.float32)
                m[owner[x:y], code[x:y] - at] = 1
                total += m[part] @ m[cols].T
            return total

        return of

    def run(key, table):
        value, together, i, j = (x.as_py() for x in key)
        ids, labels, part, n = (table[c].to_numpy() for c in ("id", "label", "block", "n_set"))
        sketches = table["sketch"].to_pylist()
        sk = [_values(s) for s in sketches]
        rows, cols = np.flatnonzero(part == i), np.flatnonzero(part == j)
        retained = common(sk, rows, cols)
        if not together:
            earlier = common([(p := _prefix(s, int(m), k, share, known.value))[p < value] for s, m in zip(sketches, n, strict=True)], rows, cols)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(rows), 512):
            r = rows[at : at + 512]
            ok = (labels[r][:, None] != labels[cols]) & (ids[r][:, None] < ids[cols] if i == j else True)
            if ok.any():
                ok &= retained(r) >= _overlap(n[r][:, None], n[cols][None, :], k, share)
            if not together and ok.any():
                ok &= earlier(r) == 0
            p, q = np.nonzero(ok)
            out_a.append(ids[r[p]])
            out_b.append(ids[cols[q]])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    many = _groups(lists.where(F.col("n") > SMALL), bound).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    many = many.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = save(many.select("value", "together", "id", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), "groups")
    some = marked(reps, [F.col("id")], many.select("id"), many.count()).where("__may").select("id", "sketch", F.col("n").alias("n_set"))
    many = many.join(some, "id").groupBy("value", "together", "i", "j").applyInArrow(run, "a long, b long")
    return few.unionByName(many).distinct()


@tidied
def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, k: int = 256) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept, text_hash, group, lead``.

    Documents with 100 * intersection >= percent * union of their shingle sets are linked; a component is
    named by its smallest doc_id, a null one coming last, and its documents with this id are ``kept``. Texts with fewer than
    ``width`` words are one shingle; null, empty and blank texts have none and link with nothing. Rows with the same doc_id
    are documents of their own; ``group`` is one number for each component (null without shingles) and ``lead`` holds for one pair of doc_id
    and ``text_hash`` in each, so that one document can be kept whatever the ids. An empty table returns no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    share = percent / 100
    sketches = save(_sketches(docs, k, width), "sketches")
    sets = save(sketches.select("id", "text_hash", "size", "hi", "lo"), "sets")
    first = F.struct("id", "text_hash")
    classes = sketches.where("size > 0").groupBy("hi", "lo", "size").agg(F.min(first).alias("first"), F.min_by("sketch", first).alias("sketch"), F.count("*").alias("rows"))
    # numbers are written once, so that they stay
    classes = save(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    discard(sketches)
    names = save(classes.select("hi", "lo", "size", "class", "first", "rows"), "names")
    every = classes.select(F.col("class").alias("id"), F.col("size").alias("n"), "sketch", "first")
    often = max(64, every.count() // 2000)
    none = _broadcast(every, {})
    first = _listed(every, k, share, none).groupBy("value").agg(F.count("*").alias("c")).where(F.col("c") > often)
    hot = {r["value"]: r["c"] for r in first.collect()}  # at most 2000 * k values
    known = _broadcast(every, hot)
    listed = save(_listed(every, k, share, known), "lists")
    bound = hot_bound(listed.count())
    lists = save(listed.groupBy("value").agg(F.count("*").alias("n"), F.min(F.struct("id", "m")).alias("hub")).where("n > 1").withColumn("long", F.col("n")), "hubs")
    shared = save(meet(listed, lists, "value", bound).withColumnRenamed("long", "n"), "shared")
    discard(listed, lists)
    # from here on only sets that share a listed value
    reps = save(every.join(shared.select("id").distinct(), "id", "left_semi"), "members")
    discard(classes)
    star = shared.where((F.col("id") != F.col("hub.id")) & _sizes_allow(F.col("m"), F.col("hub.m"), share)).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
    tested = save(_estimated(star, reps, k, share), "star")
    links = _verified(tested, docs, reps, width, percent)
    labels = save(components(links), "labels")
    rows = save(shared.join(labels.select("id", F.col("component").alias("label")), "id", "left").select("value", "id", F.coalesce("label", "id").alias("label"), "n", "m", F.col("hub.id").alias("hub")), "labelled")
    discard(shared)
    mixed = rows.groupBy("value").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("n")).where("l < m").select("value", "n")
    rows, whole = save(meet(rows, mixed, "value", bound), "mixed"), rows
    discard(whole)
    more = _across(rows, reps, k, share, known, bound).join(tested, ["a", "b"], "left_anti")
    more = save(_estimated(more, reps, k, share), "more")
    none.unpersist()
    known.unpersist()
    discard(rows, tested)
    links = links.unionByName(_verified(more, docs, reps, width, percent))
    discard(reps, more)
    labels = save(components(links), "labels2")
    named = names.join(labels.withColumnRenamed("id", "class"), "class", "left").withColumn("group", F.coalesce("component", "class"))
    leads = named.groupBy("group").agg(F.min("first").alias("lead_of"), F.count("*").alias("n"))
    named = meet(named.select("hi", "lo", "size", "group", "rows"), leads, "group", bound).withColumnRenamed("rows", "n")
    out = meet(sets, save(named, "named"), ["hi", "lo", "size"], hot_bound(sets.count()), "left")
    doc, lead = F.when(F.col("id") != NULL_ID, F.col("id")), F.coalesce("lead_of", F.struct("id", "text_hash"))
    out = out.select("id", doc.alias("doc_id"), F.col("size").alias("n_shingles"), "text_hash", "group", lead.alias("lead"))
    component = F.col("lead")["id"]
    return out.select("doc_id", "n_shingles", F.when(component != NULL_ID, component).alias("component_id"), (F.col("id") == component).alias("kept"), "text_hash", "group", (F.col("lead") == F.struct("id", "text_hash")).alias("lead"))
