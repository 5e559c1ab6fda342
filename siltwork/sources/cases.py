"""Evaluation cases from folders: ``raw.log``, ``ground_truth.json`` and ``case.json`` in a folder for each case."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The splits, each a folder of cases or of folders of cases, and the members read of the JSON files.
SPLITS = ("dev", "holdout", "stress", "v2")
TRUTH = "required_signals array<struct<importance string, evidence_lines array<array<int>>>>"
CASE = "failure_category string"


@dataclass
class Cases:
    """``lines`` (log_id, pos, line), ``signals`` and ``categories``; a log_id is the folder of the case, from the split on."""

    lines: DataFrame
    signals: DataFrame
    categories: DataFrame


def from_folders(spark: SparkSession, root: str, splits: list[str] | tuple[str, ...] = SPLITS) -> Cases:
    """The cases under ``root``, a level or two below each split. A case without a log or a ground truth is left out.

    Lines end as text lines do (LF, CR LF or CR); bytes that are no UTF-8 become U+FFFD. No case at all: empty tables.
    """

    def texts(name: str) -> DataFrame:
        d = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
        case = F.regexp_extract(F.col("_metadata.file_path"), rf"/((?:{'|'.join(splits)})/(?:[^/]+/)?[^/]+)/{name}$", 1)
        return d.select(case.alias("log_id"), "value").where("log_id <> ''")

    truth = texts("ground_truth.json").withColumn("t", F.from_json("value", TRUTH))
    raw = texts("raw.log").join(truth.select("log_id"), "log_id")
    body = F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), r"\n\z", "")  # lines of one file, in order
    lines = raw.select("log_id", F.posexplode(F.split(body, "\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))
    signals = truth.select("log_id", F.posexplode("t.required_signals").alias("signal", "s")).select("log_id", "signal", "s.importance", "s.evidence_lines")
    categories = texts("case.json").select("log_id", F.from_json("value", CASE)["failure_category"].alias("failure_category"))
    return Cases(lines, signals, categories)
