"""A corpus pipeline: language ID, near duplicates, benchmark decontamination, PII, packing.

Each stage takes what its predecessor kept, as the columns of ``documents``; the last returns placed pieces. Decisions are taken for
a pair of doc_id and text, so rows with a null or repeated doc_id are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm import decontaminate, language, minhash, packing, pii
from siltwork.llm.common import NULL_ID, discard, marked, save, table, tidied

PII_KEY = "siltwork-demo-key"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their language: ``lang`` is the predicted one. Texts in no language, null or without a letter, go.

    Learns from the labelled documents given; where none is labelled, texts with a letter stay as they are.
    """
    model = language.train(docs.where(~language.held_out()))
    if not model.languages:  # nothing to learn from: every prediction would be und
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    out = language.identify(docs, model, lang_pred="__pred", score="__score").where(F.col("__pred") != language.UNDETERMINED)
    return out.withColumn("lang", F.col("__pred")).select(docs.columns)


def _key(docs: DataFrame) -> list:
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("__id"), F.xxhash64(docs["text"]).alias("__hash")]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose pair of doc_id and ``text_hash`` is in ``gone``."""
    # saved, so that Spark knows its size and broadcasts it while it is small; else only texts that may be in it are shuffled
    gone = save(gone.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "gone")
    a, b = _key(docs)
    told = marked(docs, [a, b], gone, gone.count())
    some = told.where("__may").drop("__may")
    a, b = _key(some)
    return told.where("not __may").drop("__may").unionByName(some.join(gone, (a == gone["__id"]) & (b == gone["__hash"]), "left_anti"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (0.8, five words): the one with the smallest doc_id.

    Of rows that repeat both doc_id and text one stays; texts without words are no duplicates.
    """
    found = minhash.near_duplicates(docs, percent=80)
    out = _without(docs, found.where(~F.col("lead")))
    again = found.where("lead and group is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    again = save(again.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__id"), F.col("text_hash").alias("__hash")), "again")
    discard(found)
    if again.isEmpty():
        return out
    a, b = _key(out)
    same = (a == again["__id"]) & (b == again["__hash"])
    keyed = out.join(again, same)
    return out.join(again, same, "left_anti").unionByName(keyed.dropDuplicates(["__id", "__hash"]).select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of the benchmark."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    out = _without(docs, found.where("contaminated"))
    discard(found)
    return out


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and secrets; ``n_chars`` follows."""
    out = pii.replace_pii(docs, PII_KEY, types="__types")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents with their places in sequences of 2048 ids."""
    return packing.pack(docs, capacity=2048)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", personal_data), ("packing", packed)]

#: Language ID, surrogates and packing by tokenizer have no SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


@tidied
def _run(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    last = None
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it; what is between goes."""
    return _run(table(spark, sf_dir, "documents"), spark, sf_dir)
