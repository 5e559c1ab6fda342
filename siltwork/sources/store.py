"""Tables written to the shared folder and read back, to cut lineage where a table is used several times."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL = threading.local()


def folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset: a temporary one in local mode, else an error,
    since executors of a cluster would each write to their own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="siltwork-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/siltwork/{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run within go as soon as each ends."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` by way of a table in a new folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for paths in getattr(_LOCAL, "stored", ()):
        paths.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p.getParent(), True)  # the folder of this table alone


def discard(*tables: DataFrame) -> None:
    """Delete stored tables once what was made from them is stored in turn. Nothing may read them afterwards."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)


def tidied(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``f`` with its result stored, and all that was stored on the way deleted, also where ``f`` fails.

    The first argument of ``f`` is a table or the session.
    """

    @functools.wraps(f)
    def run(first: DataFrame | SparkSession, *args, **options) -> DataFrame:
        spark, out = first.sparkSession if isinstance(first, DataFrame) else first, None
        if not hasattr(_LOCAL, "stored"):
            _LOCAL.stored = []
        _LOCAL.stored.append([])
        try:
            out = stored(f(first, *args, **options), f.__name__)
        finally:
            for path in _LOCAL.stored.pop():
                if out is None or path != out.stored_at:
                    _delete(spark, path)
            # executors keep copies of broadcasts until the driver collects what referred to them; once for each call
            spark._jvm.System.gc()
        return out

    return run
