"""Sources of log lines, ``log_id, pos, line``, and views over the test tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def from_texts(df: DataFrame, log_id: str, text: str) -> DataFrame:
    """Each row's text is a log; lines end at LF, with one CR before it."""
    return df.select(F.col(log_id).cast("string").alias("log_id"), F.posexplode(F.split(text, "\n"))).select("log_id", F.col("pos").cast("long").alias("pos"), F.regexp_replace("col", "\r$", "").alias("line"))


def from_text(spark: SparkSession, text: str, log_id: str = "-") -> DataFrame:
    """One text, such as standard input, as a log."""
    return from_texts(spark.createDataFrame([(log_id, text)], "id string, text string"), "id", "text")


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Text files, each a log by its path; ``pos`` follows the offset of the split and the order within it.

    A large file is numbered by its splits, so no task reads it whole. An empty file is a log of one empty line.
    """
    files = spark.read.text(path, lineSep="\n")
    d = files.select(F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"), F.regexp_replace("value", "\r$", "").alias("line"))
    first = d.groupBy("log_id", "at").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("log_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = first.select("log_id", "at", "first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))
    lines = d.join(start, ["log_id", "at"]).select("log_id", (F.col("start") + F.col("row") - F.col("first")).alias("pos"), "line")
    # a scan passes empty files over; the names are in the scan's index already
    names = spark.createDataFrame([(re.sub("^file:/+", "file:/", x),) for x in files.inputFiles()], "log_id string")
    return lines.unionByName(names.join(first, "log_id", "left_anti").select("log_id", F.lit(0).cast("long").alias("pos"), F.lit("").alias("line")))


def events_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log a day from ``events``; errors have two indented frames."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").when(F.col("event_type") == "view", "DEBUG").otherwise("INFO")
    ms = F.pmod(F.col("event_id") * 37, F.lit(997))
    head = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "), level, F.lit(" user="), F.col("user_id"), F.lit(" did "), F.col("event_type"), F.lit(" in "), ms, F.lit("ms"))
    frames = F.when(F.col("event_type") == "error", F.array(head, F.concat(F.lit("    at step "), F.pmod("event_id", F.lit(5)).cast("string")), F.lit("    at main"))).otherwise(F.array(head))
    day = F.date_format("ts", "yyyy-MM-dd").alias("log_id")
    return e.select(day, F.col("event_id"), F.posexplode(frames).alias("k", "line")).select("log_id", (F.col("event_id") * 3 + F.col("k")).alias("pos"), "line")


#: The same in DuckDB.
EVENTS_PLAIN_SQL = """
ev AS (SELECT strftime(ts, '%Y-%m-%d') AS log_id, event_id, event_type,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END
  || ' user=' || user_id || ' did ' || event_type || ' in ' || ((event_id * 37) % 997) || 'ms' AS head FROM events),
lines AS (SELECT log_id, event_id * 3 AS pos, head AS line FROM ev
  UNION ALL SELECT log_id, event_id * 3 + 1, '    at step ' || (event_id % 5) FROM ev WHERE event_type = 'error'
  UNION ALL SELECT log_id, event_id * 3 + 2, '    at main' FROM ev WHERE event_type = 'error')
"""


def synthetic(spark: SparkSession, n: int, log_id: str = "bench") -> DataFrame:
    """A noisy log of ``n`` lines: health checks, requests, a warning each 100 and an error each 200 lines."""
    i = F.col("id")
    line = (
        F.when(i % 200 == 0, F.format_string("2024-01-01T00:00:%02d ERROR failed to acquire connection id=%d", i % 60, i))
        .when(i % 100 == 0, F.format_string("2024-01-01T00:00:%02d WARN pool at capacity %d", i % 60, i))
        .when(i % 20 == 0, F.format_string("2024-01-01T00:00:%02d INFO request %d done in %dms", i % 60, i, i % 500))
        .otherwise(F.format_string("2024-01-01T00:00:%02d INFO health check ok", i % 60))
    )
    return spark.range(n).select(F.lit(log_id).alias("log_id"), i.alias("pos"), line.alias("line"))


def events_as(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A log a day from ``events`` as ``json``, ``logfmt``, ``klog`` or ``syslog``, with levels absent, null or of other types."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, of = F.col("event_id"), F.col("event_type")
    n = i.cast("string")
    word = F.when(of == "error", "error").when(of == "purchase", "warn").when(of == "view", "debug").otherwise("info")
    did = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), of)
    clock = F.date_format("ts", "HH:mm:ss")
    if kind == "json":
        level = F.when(i % 7 == 0, '"level":null').when(i % 7 == 1, '"level":50').otherwise(F.concat(F.when(i % 7 == 2, '"severity"').otherwise('"level"'), F.lit(':"'), word, F.lit('"')))
        line = F.concat(F.lit("{"), level, F.lit(',"ts":'), F.when(i % 5 == 0, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n), F.lit(',"msg":"'), did, F.lit('"}'))
    elif kind == "logfmt":
        line = F.concat(F.lit("at="), n, F.when(i % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(' level="'), word, F.lit('"'))), F.lit(" msg="), F.replace(did, F.lit(" "), F.lit("_")))
    elif kind == "klog":
        letter = F.when(of == "error", "E").when(of == "purchase", "W").when(of == "signup", "F").otherwise("I")
        line = F.concat(letter, F.date_format("ts", "MMdd "), clock, F.lit(" 7 app.go:"), n, F.lit("] "), did)
    else:
        line = F.concat(F.date_format("ts", "MMM dd "), clock, F.lit(" host app["), n, F.lit("]: ["), F.upper(word), F.lit("] "), did)
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("log_id"), i.alias("pos"), line.alias("line"))


_WORD = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'view' THEN 'debug' ELSE 'info' END"
_DID = "'user ' || user_id || ' did ' || event_type"
#: The same in DuckDB: a line by kind.
EVENTS_AS_SQL = {
    "json": f"""'{{' || CASE event_id % 7 WHEN 0 THEN '"level":null' WHEN 1 THEN '"level":50' WHEN 2 THEN '"severity":"' || {_WORD} || '"' ELSE '"level":"' || {_WORD} || '"' END
  || ',"ts":' || CASE WHEN event_id % 5 = 0 THEN '"' || event_id || '"' ELSE event_id::VARCHAR END || ',"msg":"' || {_DID} || '"}}'""",
    "logfmt": f"""'at=' || event_id || CASE WHEN event_id % 5 = 0 THEN '' ELSE ' level="' || {_WORD} || '"' END || ' msg=' || replace({_DID}, ' ', '_')""",
    "klog": f"CASE event_type WHEN 'error' THEN 'E' WHEN 'purchase' THEN 'W' WHEN 'signup' THEN 'F' ELSE 'I' END || strftime(ts, '%m%d %H:%M:%S') || ' 7 app.go:' || event_id || '] ' || {_DID}",
    "syslog": f"strftime(ts, '%b %d %H:%M:%S') || ' host app[' || event_id || ']: [' || upper({_WORD}) || '] ' || {_DID}",
}


def events_as_sql(kind: str) -> str:
    return f"lines AS (SELECT strftime(ts, '%Y-%m-%d') AS log_id, event_id AS pos, {EVENTS_AS_SQL[kind]} AS line FROM events)"


#: Texts by number, one each for the rules that the tables alone never meet: (Spark and DuckDB) expressions over ``n``, an id as
#: text, and ``h``, its md5. Both engines read them alike.
SECRETS = (
    "concat('jwt eyJ', h, '.', h, '.', n, ' end')", "concat('key AKIA', upper(substr(h, 1, 16)), ' end')", "concat('sent Bearer ', h, '== to all')",
    "concat('-----BEGIN RSA PRIVATE KEY-----', h, '-----END RSA PRIVATE KEY----- tail')", "concat('postgres://u', n, ':', h, '@db/x')", "concat('mail u', n, '@example.com now')",
    "concat('Authorization: Basic ', h, ', x')", "concat('run --password ', h, ' now')", "concat('password=\"', h, ' two\" x')", "concat('{\"api_key\":\"', h, '\"}')",
    "concat('plain ', n, ' text')", "concat('token=', n, ' secret: ', h)",
)
TOKENS = (
    "concat('id ', h)", "concat('see  (', h, '), then')", "concat('x=', h, '/', n, '  y')", "concat('short ', substr(h, 1, 19))", "concat('low ', repeat('ab', 12), ' ')", "concat(h, '.', h)", "concat('  ', upper(h), '! ', h, '?')",
)
SHAPES = (
    "concat('2024-01-02T03:04:05.', n, 'Z up')", "concat('at 17', lpad(n, 8, '0'), ' x')", "concat('12:34:56,', n, ' tick')", "concat('id ', substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12))",
    "concat('ptr 0x', substr(h, 1, 8), ' free')", "concat(h, ' sum')", "concat('from 10.0.', substr(n, 1, 2), '.7:8080 conn')", "concat('via ', substr(h, 1, 4), ':', substr(h, 5, 4), ':', substr(h, 9, 4), ':', substr(h, 13, 4), ':', substr(h, 17, 4), ' hop')",
    "concat('took ', n, '.5ms or 3h  or 7us')", "concat('n ', n, ' a1 22b 333')",
)


def shapes(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    """``event_id, line`` with a text of each of ``kinds`` in turn."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "cast(event_id AS string) AS n", "md5(cast(event_id AS string)) AS h")
    line = None
    for i, x in enumerate(kinds):
        here = F.col("event_id") % len(kinds) == i
        line = F.when(here, F.expr(x)) if line is None else line.when(here, F.expr(x))
    return e.select("event_id", line.alias("line"))


def shapes_sql(kinds: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(kinds))
    return f"shapes AS (SELECT event_id, CASE event_id % {len(kinds)} {cases} END AS line FROM (SELECT event_id, event_id::VARCHAR AS n, md5(event_id::VARCHAR) AS h FROM events))"


FRAMED = ("json", "logfmt", "klog", "syslog")


def events_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs of :func:`events_as` of all kinds; every sixth line is followed by two frames."""
    out = None
    for kind in FRAMED:
        d = events_as(spark, sf_dir, kind)
        if kind == "logfmt":
            d = d.withColumn("line", F.when(F.col("pos") % 4 == 1, F.replace("line", F.lit("level="), F.lit("lvl="))).when(F.col("pos") % 4 == 2, F.replace("line", F.lit("level="), F.lit("severity="))).otherwise(F.col("line")))
        frames = F.when(F.col("pos") % 6 == 0, F.array(F.col("line"), F.lit("    at step"), F.lit("\tat main"))).otherwise(F.array("line"))
        d = d.select(F.concat(F.lit(f"{kind}-"), "log_id").alias("log_id"), "pos", F.posexplode(frames).alias("k", "line")).select("log_id", (F.col("pos") * 3 + F.col("k")).alias("pos"), "line")
        out = d if out is None else out.unionByName(d)
    return out


def _framed_sql() -> str:
    parts = []
    for kind in FRAMED:
        line = EVENTS_AS_SQL[kind]
        if kind == "logfmt":
            line = f"CASE event_id % 4 WHEN 1 THEN replace({line}, 'level=', 'lvl=') WHEN 2 THEN replace({line}, 'level=', 'severity=') ELSE {line} END"
        parts.append(f"SELECT '{kind}' AS format, '{kind}-' || strftime(ts, '%Y-%m-%d') AS log_id, event_id, {line} AS line FROM events")
    return f"""heads AS ({' UNION ALL '.join(parts)}),
lines AS (SELECT format, log_id, event_id * 3 AS pos, line, true AS starts FROM heads UNION ALL SELECT format, log_id, event_id * 3 + 1, '    at step', false FROM heads WHERE event_id % 6 = 0
  UNION ALL SELECT format, log_id, event_id * 3 + 2, chr(9) || 'at main', false FROM heads WHERE event_id % 6 = 0)"""


EVENTS_FRAMED_SQL = _framed_sql()
