"""Logs named in prompts: the first path in a prompt that is a long enough file, and the answer to the prompt's hook."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a path looks like, and how many lines make a log.
PATH = r"(?:^|\s)((?:/|\.\.?/|~/|[A-Z]:\\)[\w./\\-]+)"
LEAST_LINES = 500


def from_json(df: DataFrame, value: str = "value") -> DataFrame:
    """``prompt`` of a JSON object, other members ignored; null where there is none, the text is bad or the prompt empty."""
    p = F.from_json(value, "prompt string")["prompt"]
    return df.withColumn("prompt", F.when(p != "", p))


def files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of text files, paths without a scheme; a file is one row."""
    where = F.regexp_replace(F.col("_metadata.file_path"), "^file:(?://)?", "")
    return spark.read.text(path, wholetext=True).select(where.alias("path"), F.col("value").alias("content"))


def prompt_paths(prompts: DataFrame, prompt_id: str = "prompt_id") -> DataFrame:
    """``prompt_id, at, path``: what looks like a path, in order."""
    found = F.regexp_extract_all("prompt", F.lit(f"(?mU){PATH}"), F.lit(1))
    return prompts.select(prompt_id, F.posexplode(found).alias("at", "path"))


def detect(prompts: DataFrame, logs: DataFrame, prompt_id: str = "prompt_id", least_lines: int = LEAST_LINES) -> DataFrame:
    """``prompt_id, path, n_lines``: each prompt's first path that is in ``logs(path, content)`` with enough lines."""
    n = logs.select("path", F.size(F.split("content", "\n")).alias("pieces"), F.size(F.split(F.regexp_replace("content", r"\n\z", ""), "\n")).cast("long").alias("n_lines")).where(F.col("pieces") >= least_lines)
    hits = prompt_paths(prompts, prompt_id).join(n, "path")
    return hits.groupBy(prompt_id).agg(F.min_by(F.struct("path", "n_lines"), "at").alias("x")).select(prompt_id, "x.*")


def context(detected: DataFrame, outputs: DataFrame) -> DataFrame:
    """``detected`` with ``context``: a note on the log and its reduction; ``outputs`` are ``log_id`` (the path) and ``text``."""
    note = F.concat(
        F.lit("siltwork hook: `"), "path", F.lit("` is a log of "), F.col("n_lines").cast("string"), F.lit(" lines. Work from its reduced form below instead of the raw file; for more detail, run `python -m siltwork "),
        "path", F.lit(" --context 5` or raise `--budget`.\n--- LOG (reduced from "), F.col("n_lines").cast("string"), F.lit(" lines) ---\n"), "text", F.lit("---\n"),
    )
    return detected.join(outputs.withColumnRenamed("log_id", "path"), "path").withColumn("context", note).drop("text")


def answers(prompts: DataFrame, contexts: DataFrame, prompt_id: str = "prompt_id") -> DataFrame:
    """``prompt_id, answer``: the hook's JSON for every prompt, ``{}`` where nothing was found."""
    hook = F.struct(F.struct(F.lit("UserPromptSubmit").alias("hookEventName"), F.col("context").alias("additionalContext")).alias("hookSpecificOutput"))
    d = prompts.select(prompt_id).join(contexts.select(prompt_id, "context"), prompt_id, "left")
    return d.select(prompt_id, F.when(F.col("context").isNotNull(), F.to_json(hook)).otherwise("{}").alias("answer"))
