"""Template counts of unbounded logs, and reductions of each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from siltwork.config import ReduceConfig
from siltwork.functions import text as T
from siltwork.operators.reduce import Reduced, reduce_logs


def template_counts(lines: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, template, sev, n`` by windows of ``ts``; state goes once a window is ``late``."""
    d = lines.withWatermark(ts, late).select(ts, T.mask(F.col("line")).alias("template"), T.infer_severity(F.col("line")).cast("int").alias("sev"))
    return d.groupBy(F.window(ts, window).alias("w"), "template", "sev").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "template", "sev", "n")


def reduce_batches(lines: DataFrame, sink: Callable[[Reduced, int], None], cfg: ReduceConfig | None = None) -> DataStreamWriter:
    """Each micro-batch of ``log_id, pos, line`` as a set of logs of its own; ``sink`` gets the reduction and the batch's number."""
    return lines.writeStream.foreachBatch(lambda batch, n: sink(reduce_logs(batch, cfg), n))
