"""Sinks of reductions: texts, rendered rows, statistics, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def texts(output: DataFrame) -> DataFrame:
    """``log_id, text``: header, a blank line and the body."""
    return output.select("log_id", F.concat("header", F.lit("\n"), "body").alias("text"))


def write_texts(output: DataFrame, path: str) -> None:
    """A folder a log with its text; the sink ends it with the line end it has."""
    d = texts(output).withColumn("text", F.regexp_replace("text", r"\n\z", ""))
    d.repartition("log_id").write.partitionBy("log_id").mode("overwrite").text(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """Rendered rows in the order of logs and records; logs larger than a task's memory spread over several files."""
    rows.repartitionByRange("log_id", "ord").sortWithinPartitions("log_id", "ord").select("text").write.mode("overwrite").text(path)


def stats(output: DataFrame) -> DataFrame:
    """``log_id, stats``: records and tokens before and after, and the share of tokens left in percent."""
    share = F.when(F.col("input_tokens") > 0, F.col("output_tokens") / F.nullif("input_tokens", F.lit(0)) * 100).otherwise(0.0)
    s = lambda c: F.col(c).cast("string")
    return output.select("log_id", F.concat(s("input_records"), F.lit(" lines → "), s("kept_records"), F.lit(" kept | tokens "), s("input_tokens"), F.lit(" → "), s("output_tokens"), F.lit(" ("), F.format_string("%.1f", share), F.lit("%)")).alias("stats"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines: manifests and reports."""
    df.write.mode("overwrite").json(path)


def write_array(df: DataFrame, path: str, order: str) -> None:
    """Files that make one JSON array in the order of their names, rows by ``order`` and indented; no row: an empty array.

    Sorted by range, so that no task holds all rows; ``order`` is unique.
    """
    ends = df.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    if ends["low"] is None:
        df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    text = F.regexp_replace(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}), "(?m)^", "  ")
    text = F.concat(F.when(F.col(order) == ends["low"], "[\n").otherwise(""), text, F.when(F.col(order) == ends["high"], "\n]").otherwise(","))
    df.repartitionByRange(order).sortWithinPartitions(order).select(text.alias("value")).write.mode("overwrite").text(path)
