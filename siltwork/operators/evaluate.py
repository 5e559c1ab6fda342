"""Evaluation of reductions: fingerprints, signal recall, line classes, reduction figures, tail truncation.

``lines`` are ``log_id, pos, line`` with ``pos`` dense from 0; ``outputs`` are ``log_id, text``; ``signals`` are
``log_id, signal, importance, evidence_lines`` with spans of line numbers from 1, both ends included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork.functions.text import squeeze

# Terminal codes, the time stamp of CI lines, the shortest fingerprint and the part of it that is looked up.
ANSI = r"\x1b\[[0-9;]*m|\x1b\[K"
CI_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z\s*"
LEAST_CHARS = 12
KEY_CHARS = 60
MAX_BYTES = 200_000


def strip_noise(line: Column) -> Column:
    """Without terminal codes, the CI time stamp and outer white space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(line, ANSI, ""), f"(?U){CI_TIME}", ""), r"(?U)^\s+|\s+$", "")


def fingerprint(line: Column, least: int = LEAST_CHARS) -> Column:
    """The content of a line with single spaces; null if it is shorter than ``least``."""
    s = squeeze(strip_noise(line))
    return F.when(F.char_length(s) >= least, s)


def physical_lines(text: Column) -> Column:
    """Lines of a text at LF; the end of the last line starts no further one, an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))


def evidence(lines: DataFrame, signals: DataFrame) -> DataFrame:
    """``log_id, signal, key``: what to look for. Spans are clipped to the log first, so a wild end costs nothing."""
    n = lines.groupBy("log_id").agg(F.count("*").alias("n"))
    s = signals.select("log_id", "signal", F.explode("evidence_lines").alias("span")).join(n, "log_id")
    s = s.select("log_id", "signal", F.greatest(F.col("span")[0], F.lit(1)).cast("long").alias("lo"), F.least(F.col("span")[1].cast("long"), "n").alias("hi")).where("lo <= hi")
    at = s.select("log_id", "signal", F.explode(F.sequence("lo", "hi")).alias("at")).withColumn("pos", F.col("at") - 1)
    key = F.substring(fingerprint(F.col("line")), 1, KEY_CHARS)
    return at.join(lines, ["log_id", "pos"]).select("log_id", "signal", key.alias("key")).where("key is not null").distinct()


def signal_hits(lines: DataFrame, outputs: DataFrame, signals: DataFrame) -> DataFrame:
    """``log_id, signal, importance, hit``: whether a line of the evidence shows in the log's output."""
    plain = F.array_join(F.transform(physical_lines(F.col("text")), lambda x: squeeze(strip_noise(x))), "\n")
    found = evidence(lines, signals).join(outputs.select("log_id", plain.alias("plain")), "log_id").where(F.contains("plain", "key")).select("log_id", "signal").distinct()
    d = signals.select("log_id", "signal", "importance").join(found.withColumn("hit", F.lit(True)), ["log_id", "signal"], "left")
    return d.withColumn("hit", F.coalesce("hit", F.lit(False)))


def signal_recall(hits: DataFrame, logs: DataFrame) -> DataFrame:
    """Per log of ``logs``: recall, hits and totals of critical and important signals; recall is 1 without signals."""
    of = lambda kind: F.col("importance") == kind
    sums = [x for k in ("critical", "important") for x in (F.count_if(of(k) & F.col("hit")).alias(f"{k}_hits"), F.count_if(of(k)).alias(f"{k}_total"))]
    d = logs.select("log_id").distinct().join(hits.groupBy("log_id").agg(*sums), "log_id", "left")
    out = [F.col("log_id")]
    for k in ("critical", "important"):
        h, t = (F.coalesce(f"{k}_{x}", F.lit(0)).cast("long") for x in ("hits", "total"))
        out += [F.when(t == 0, 1.0).otherwise(F.round(h / F.nullif(t, F.lit(0)), 3)).alias(f"{k}_recall"), h.alias(f"{k}_hits"), t.alias(f"{k}_total")]
    return d.select(out)


def line_classes(outputs: DataFrame) -> DataFrame:
    """``log_id, header_lines, gap_lines, kept_lines`` of an output's text."""
    lines = physical_lines(F.col("text"))
    head = F.size(F.filter(lines, lambda x: x.startswith("#"))).cast("long")
    gap = F.size(F.filter(lines, lambda x: x.startswith("…"))).cast("long")
    return outputs.select("log_id", head.alias("header_lines"), gap.alias("gap_lines"), (F.size(lines) - head - gap).alias("kept_lines"))


def case_report(lines: DataFrame, outputs: DataFrame, signals: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """A row a log: lines, kept lines, share kept, recall by importance, and ``failure_category`` (``?`` if unknown)."""
    raw = lines.groupBy("log_id").agg(F.count("*").alias("raw_lines"))
    d = raw.join(line_classes(outputs).select("log_id", "kept_lines"), "log_id").join(signal_recall(signal_hits(lines, outputs, signals), raw), "log_id")
    d = d.withColumn("keep_pct", F.round(F.col("kept_lines") / F.greatest("raw_lines", F.lit(1)) * 100, 1))
    if categories is None:
        return d.withColumn("failure_category", F.lit("?"))
    return d.join(categories.select("log_id", "failure_category"), "log_id", "left").fillna("?", ["failure_category"])


def overall(report: DataFrame) -> DataFrame:
    """One row over all logs: mean recall and share kept by log, hits and totals over all signals."""
    r = lambda c, n: F.round(F.avg(c), n)
    return report.agg(F.count("*").alias("cases"), r("critical_recall", 6).alias("avg_critical_recall"), F.sum("critical_hits").alias("critical_hits"), F.sum("critical_total").alias("critical_total"), r("keep_pct", 6).alias("avg_keep_pct"))


def reduction_pct(before: Column, after: Column) -> Column:
    return F.round((1 - after / F.greatest(before, F.lit(1))) * 100, 1)


def reduction_ratio(before: Column, after: Column) -> Column:
    return F.round(1 - after / F.greatest(before, F.lit(1)), 6)


def sizes(lines: DataFrame, outputs: DataFrame) -> DataFrame:
    """Lines and bytes of logs and their outputs, with both reductions in percent. A line of a log ends in one byte."""
    raw = lines.groupBy("log_id").agg(F.count("*").alias("raw_lines"), F.sum(F.octet_length("line") + 1).alias("raw_bytes"))
    out = outputs.select("log_id", F.size(physical_lines(F.col("text"))).cast("long").alias("reduced_lines"), F.octet_length("text").cast("long").alias("reduced_bytes"))
    d = raw.join(out, "log_id")
    return d.withColumn("line_reduction_pct", reduction_pct(F.col("raw_lines"), F.col("reduced_lines"))).withColumn("byte_reduction_pct", reduction_pct(F.col("raw_bytes"), F.col("reduced_bytes")))


def manifest(lines: DataFrame, outputs: DataFrame, method: str, budget: int, raw_path: Column, context_path: Column, binary: str = "siltwork") -> DataFrame:
    """A manifest row a log. Ranges of lines are not tracked and empty."""
    return sizes(lines, outputs).select(
        F.col("log_id").alias("case_id"), F.lit(method).alias("method"), F.lit("context_provider").alias("mode"), raw_path.alias("raw_log_path"), context_path.alias("context_path"),
        F.col("raw_lines").alias("input_line_count"), F.col("reduced_lines").alias("output_line_count"), F.col("raw_bytes").alias("input_byte_size"), F.col("reduced_bytes").alias("output_byte_size"),
        reduction_ratio(F.col("raw_lines"), F.col("reduced_lines")).alias("reduction_ratio"), F.array().cast("array<array<int>>").alias("included_line_ranges"),
        F.struct(F.lit(budget).alias("budget_tokens"), F.lit(binary).alias("binary")).alias("metadata"),
    )


def tail_truncate(rows: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``log_id, ord, text`` of physical lines cut to ``max_bytes``: headers, a note, then the longest end of the body that fits.

    Logs that fit stay as they are. A null text counts as empty.
    """
    d = rows.select("log_id", "ord", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("bytes", (F.octet_length("text") + 1).cast("long")).withColumn("head", F.col("text").startswith("#"))
    total = d.groupBy("log_id").agg(F.sum("bytes").alias("total"), F.sum(F.when(F.col("head"), F.col("bytes")).otherwise(0)).alias("heads"))
    d = d.join(total, "log_id")
    after = Window.partitionBy("log_id", "head").orderBy(F.desc("ord"))
    d = d.withColumn("end", F.sum("bytes").over(after)).withColumn("long", F.col("total") > max_bytes)
    fits = ~F.col("long") | F.col("head") | (F.col("end") <= max_bytes - F.col("heads"))
    kept = d.where(fits).select("log_id", F.when(F.col("long") & ~F.col("head"), 2).otherwise(0).alias("part"), "ord", "text")
    skipped = d.where("long").groupBy("log_id").agg(F.count_if(~fits).alias("k"))
    note = skipped.select("log_id", F.lit(1).alias("part"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("… "), F.col("k").cast("string"), F.lit(" lines truncated (context too large for LLM) …")).alias("text"))
    out = kept.unionByName(note)
    return out.select("log_id", (F.row_number().over(Window.partitionBy("log_id").orderBy("part", "ord")) - 1).cast("long").alias("ord"), "text")
