"""Joins of wide rows with keys, and long lists: what is shuffled, and that nothing is lost."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltwork.llm import common, minhash

from .test_operators import brute_near, near_rows


def shuffled(spark):
    """Bytes of shuffles that all stages so far have written."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture
def no_broadcast(spark):
    """Every join is as that of tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_that_stay_are_not_shuffled(spark, no_broadcast):
    text = lambda i: "".join(hashlib.sha256(f"{i} {j}".encode()).hexdigest() for j in range(200))
    rows = [(i if i % 5 else None, text(i)) for i in range(400)] + [(1, text(2)), (2, text(2)), (7, None), (None, None)]
    docs = common.save(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    some = docs.where("doc_id in (1, 7) and (text is null or text <> '%s') or doc_id is null and (text is null or text like '%%0')" % text(2))
    gone, bad = some.select("doc_id", F.xxhash64("text").alias("text_hash")), {tuple(r) for r in some.collect()}
    before = shuffled(spark)
    out = common.save(corpus_pipeline._without(docs, gone), "out")
    assert shuffled(spark) - before < 1_000_000 < sum(len(t or "") for _, t in rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert 4 < len(bad) < 40 and sorted(map(tuple, out.collect()), key=key) == sorted((x for x in rows if x not in bad), key=key)


def test_marked_misses_no_key(spark):
    big = spark.range(20_000).select("id", F.lit("x").alias("text"))
    keys = spark.range(0, 20_000, 10).select("id")
    for marks in (1 << 20, 16, 1):  # with few words it tells less, but never that a key is not there
        got = common.marked(big, [F.col("id")], keys, 2000, marks)
        assert got.columns == ["id", "text", "__may"] and got.count() == 20_000
        assert got.where("__may and id % 10 = 0").count() == 2000
    assert common.marked(big, [F.col("id")], keys, 2000).where("__may and id % 10 <> 0").count() < 1800
    assert common.marked(big, [F.col("id")], keys.limit(0), 0).where("__may").count() == 0


def test_long_lists_of_a_hub_are_one_group(spark):
    same = [(v, i, i, 20, 5) for v in range(10) for i in range(5, 25)]  # ten lists of the same members
    apart = [(100 + v, i, i, 20, 50) for v in range(10) for i in (50, *range(1000 + 19 * v, 1019 + 19 * v))]  # ten lists with only the hub in common
    lists = spark.createDataFrame(same + apart, "value long, id long, label long, n long, hub long")
    got = minhash._groups(lists, 1000)
    assert sorted((r["value"], r["id"], r["n"]) for r in got.where("together").collect()) == [(5, i, 20) for i in range(5, 25)]
    assert sorted((r["value"], r["id"], r["n"]) for r in got.where("not together").collect()) == sorted((v, i, 20) for v, i, *_ in apart)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_copies_among_many_texts_with_one_passage(spark, percent):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(70):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 60))]
        rows.append((i, " ".join(passage + own)))
        if i % 3 == 0:  # beside the hub's component
            rows.append((1000 + i, " ".join(passage + own[: -1 - i % 12])))
    order = np.random.default_rng(5).permutation(len(rows))
    rows = [rows[i] for i in order]
    want = sorted(brute_near(rows, percent))
    assert sum(not kept for *_, kept in want) > 15
    assert near_rows(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent)) == want
