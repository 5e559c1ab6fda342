"""Queries over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltwork.config import ReduceConfig
from siltwork.functions import text as T
from siltwork.operators import evaluate as E
from siltwork.operators import reduce as R
from siltwork.sources import logs, prompts, sinks
from siltwork.sources.store import folder, stored, tidied
from siltwork.streaming import templates as streams

RAW = ReduceConfig(redact=False, budget=2000)
MAX_LINES, SYNTHETIC = 35, 1_000_000


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.events_plain(spark, sf_dir)


def _records(spark, sf_dir):
    return R.templated(R.fields(R.records(_lines(spark, sf_dir))).drop("message"), RAW)


def _docs(spark, sf_dir):
    return logs.from_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def doc_lines(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("log_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("line").rlike(r"(?U)\S")).alias("n_kept"), F.sum(F.length("line")).alias("chars"))


def format_scores(spark, sf_dir):
    return R.format_scores(_docs(spark, sf_dir))


def format_detect(spark, sf_dir):
    return R.detect_format(_lines(spark, sf_dir))


def record_assembly(spark, sf_dir):
    return R.records(_lines(spark, sf_dir)).select("log_id", "idx", "raw")


def level_infer(spark, sf_dir):
    return _lines(spark, sf_dir).select("log_id", T.infer_severity(F.col("line")).cast("int").alias("sev")).groupBy("log_id", "sev").agg(F.count("*").alias("n"))


def mask_templates(spark, sf_dir):
    return _docs(spark, sf_dir).select("log_id", "pos", T.mask(F.col("line")).alias("template"))


def template_stats(spark, sf_dir):
    return R.templates(_records(spark, sf_dir)).select("log_id", "template", "cnt", "first_idx", F.round("rarity", 4).alias("rarity"))


def severity_counts(spark, sf_dir):
    return _records(spark, sf_dir).groupBy("log_id").agg(*[F.count_if(F.col("sev") == i).alias(T.LABELS[i].lower()) for i in range(5)])


def redact_patterns(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(T.redact_patterns(F.col("text"))).alias("redacted_md5"))


def _kept(r: R.Reduced) -> DataFrame:
    return r.records.select("log_id", "idx", "template").join(r.kept, ["log_id", "idx"])


@tidied
def selected(spark, sf_dir):
    return _kept(R.reduce_logs(_lines(spark, sf_dir), RAW))


@tidied
def selected_max_lines(spark, sf_dir):
    """The selection under a cap on lines."""
    return _kept(R.reduce_logs(_lines(spark, sf_dir), ReduceConfig(redact=False, budget=2000, max_lines=MAX_LINES)))


@tidied
def render_rows(spark, sf_dir):
    return R.reduce_logs(_lines(spark, sf_dir), RAW).rows


@tidied
def reduce_output(spark, sf_dir):
    return R.reduce_logs(_lines(spark, sf_dir), ReduceConfig(budget=2000)).output()


@tidied
def reduce_json(spark, sf_dir):
    """Reductions of JSON logs, whose headers have the range of time."""
    return R.reduce_logs(logs.events_as(spark, sf_dir, "json"), ReduceConfig(budget=2000, redact=False)).output()


@tidied
def reduce_blank(spark, sf_dir):
    """Logs of blank lines only, a day each, get a header and no body."""
    blank = logs.events_plain(spark, sf_dir).select("log_id", "pos", F.when(F.col("pos") % 2 == 0, " \t").otherwise("").alias("line"))
    return R.reduce_logs(blank).output()


@tidied
def reduce_stats(spark, sf_dir):
    """The line of statistics of each reduction."""
    return sinks.stats(R.reduce_logs(_lines(spark, sf_dir), RAW).output())


@tidied
def written_texts(spark, sf_dir):
    """Reductions as the sink of texts writes them, read back."""
    path = f"{folder(spark)}/texts"
    sinks.write_texts(R.reduce_logs(_lines(spark, sf_dir), RAW).output(), path)
    d = spark.read.schema("value string, log_id string").text(path, wholetext=True)
    return d.groupBy("log_id").agg(F.md5(F.regexp_replace(F.max("value"), r"\n\z", "")).alias("text_md5"))


def file_lines(spark, sf_dir):
    """A file a day of the events' lines, read back as logs."""
    path = f"{folder(spark)}/files"
    lines = _lines(spark, sf_dir)
    lines.withColumn("line", F.concat("line", F.when(F.col("pos") % 2 == 0, "\r").otherwise(""))).repartition("log_id").sortWithinPartitions("log_id", "pos").select("log_id", "line").write.partitionBy("log_id").text(path)
    d = logs.from_files(spark, f"{path}/log_id=*")
    return d.select(F.regexp_extract("log_id", "log_id=([^/]*)/", 1).alias("log_id"), "pos", "line")


def hook_answers(spark, sf_dir):
    """Answers to prompts that name documents as files: the parts of the JSON."""
    ask, files = _asked(spark, sf_dir)
    p = prompts.from_json(ask)
    found = prompts.detect(p, files, least_lines=5)
    answer = prompts.answers(p, prompts.context(found, files.select(F.col("path").alias("log_id"), F.concat("content", F.lit("\n")).alias("text"))))
    part = lambda name: F.get_json_object("answer", f"$.hookSpecificOutput.{name}")
    return answer.select("prompt_id", part("hookEventName").alias("event"), F.md5(part("additionalContext")).alias("context_md5"))


def redact_shapes(spark, sf_dir):
    """A text of each kind of secret."""
    return logs.shapes(spark, sf_dir, logs.SECRETS).select("event_id", T.redact_patterns(F.col("line")).alias("redacted"))


def redact_tokens(spark, sf_dir):
    """Tokens of high and low entropy."""
    return logs.shapes(spark, sf_dir, logs.TOKENS).select("event_id", T.redact_entropy(F.col("line")).alias("redacted"))


def mask_shapes(spark, sf_dir):
    """A text for each mask."""
    return logs.shapes(spark, sf_dir, logs.SHAPES).select("event_id", T.mask(F.col("line")).alias("template"))


@tidied
def record_shapes(spark, sf_dir):
    """Records with continuations in all formats, with severity, time and message."""
    d = R.fields(R.records(logs.events_framed(spark, sf_dir)))
    return d.select("log_id", "idx", "format", F.md5("raw").alias("raw_md5"), F.col("sev").cast("int").alias("sev"), "ts", "message")


def _fields_of(kind):
    def query(spark, sf_dir):
        d = R.fields(R.records(logs.events_as(spark, sf_dir, kind)))
        return d.groupBy("log_id", "format", F.col("sev").cast("int").alias("sev")).agg(F.count("*").alias("n"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"))

    query.__name__ = f"{kind}_fields"
    return query


def template_topk(spark, sf_dir):
    t = R.templates(_records(spark, sf_dir))
    w = Window.partitionBy("log_id").orderBy(F.desc("cnt"), F.desc("rarity"), "template")
    return t.withColumn("r", F.row_number().over(w)).where("r <= 5").select("log_id", F.col("r").cast("long").alias("r"), "template", "cnt")


def document_frequency(spark, sf_dir):
    t = _records(spark, sf_dir).select("log_id", "template").distinct()
    return t.select("log_id", "template", F.explode(F.array_distinct(F.split("template", " "))).alias("term")).where("term <> ''").groupBy("log_id", "term").agg(F.count("*").alias("df"))


def blended_scores(spark, sf_dir):
    recs = _records(spark, sf_dir)
    return R.scored(recs, R.templates(recs), RAW).select("log_id", "idx", F.round("score", 6).alias("score"))


def entropy_tokens(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(F.split("text", r"(?U)\s+")).alias("token")).where("token <> ''").distinct()
    return d.select("doc_id", "token", F.round(T.entropy(F.col("token")), 6).alias("bits"))


@tidied
def synth_log(spark, sf_dir):
    """One log of a million lines, from lines to its reduction."""
    return R.reduce_logs(logs.synthetic(spark, SYNTHETIC), RAW).output()


@tidied
def synth_templates(spark, sf_dir):
    return R.templates(R.templated(R.fields(R.records(logs.synthetic(spark, SYNTHETIC))).drop("message"), RAW)).select("template", "cnt", "first_idx")


def _numbered(spark, sf_dir):
    return _lines(spark, sf_dir).select("log_id", (F.row_number().over(Window.partitionBy("log_id").orderBy("pos")) - 1).cast("long").alias("pos"), "line")


def _signals(lines):
    """Errors of each log, with their frames as evidence."""
    at = (F.col("pos") + 1).cast("int")
    kind = F.when(F.col("pos") % 3 == 0, "critical").otherwise("important")
    return lines.where(F.col("line").contains(" ERROR ")).select("log_id", F.col("pos").alias("signal"), kind.alias("importance"), F.array(F.array(at, at + 2)).alias("evidence_lines"))


def _outputs(spark, sf_dir):
    lines = stored(_numbered(spark, sf_dir), "lines")
    return lines, stored(sinks.texts(R.reduce_logs(lines, RAW).output()), "texts")


def fingerprints(spark, sf_dir):
    return _docs(spark, sf_dir).select("log_id", "pos", E.fingerprint(F.col("line")).alias("fingerprint"))


def evidence_keys(spark, sf_dir):
    lines = _numbered(spark, sf_dir)
    return E.evidence(lines, _signals(lines))


@tidied
def signal_recall(spark, sf_dir):
    lines, out = _outputs(spark, sf_dir)
    return E.case_report(lines, out, _signals(lines))


@tidied
def recall_overall(spark, sf_dir):
    lines, out = _outputs(spark, sf_dir)
    return E.overall(E.case_report(lines, out, _signals(lines)))


@tidied
def reduction_manifest(spark, sf_dir):
    lines, out = _outputs(spark, sf_dir)
    path = lambda ext: F.concat("log_id", F.lit(ext))
    m = E.manifest(lines, out, "siltwork-2k", 2000, path("/raw.log"), path(".txt"))
    return m.select(*[c for c in m.columns if c not in ("metadata", "included_line_ranges")], F.size("included_line_ranges").alias("ranges"), "metadata.budget_tokens", "metadata.binary")


@tidied
def reduction_sizes(spark, sf_dir):
    return E.sizes(*_outputs(spark, sf_dir))


def tail_truncate(spark, sf_dir):
    """Documents cut to 600 bytes by lines; every fifth line is a header."""
    rows = _docs(spark, sf_dir).select("log_id", F.col("pos").alias("ord"), F.when(F.col("pos") % 5 == 0, F.concat(F.lit("# "), "line")).otherwise(F.col("line")).alias("text"))
    return E.tail_truncate(rows, 600)


def _asked(spark, sf_dir):
    """Prompts that name documents as files, and the files."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = d.select(F.concat(F.lit("/logs/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    ask = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws("-", "conv_id", "turn").alias("prompt_id"), F.to_json(F.struct(F.concat("text", F.lit(" see ./none.txt and /logs/"), "conv_id", F.lit(".txt or /logs/"), F.col("conv_id") + F.col("turn"), F.lit(".txt")).alias("prompt"))).alias("value"))
    return ask, files


def prompt_paths(spark, sf_dir):
    """The log of each prompt; documents of at least 5 lines count as logs."""
    ask, files = _asked(spark, sf_dir)
    return prompts.detect(prompts.from_json(ask), files, least_lines=5)


def stream_templates(spark, sf_dir):
    """Windowed template counts of ``events`` read as a stream; windows that the watermark has closed."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    line = F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" "), F.upper("event_type"))
    counts = streams.template_counts(e.select(F.col("ts").cast("timestamp").alias("ts"), line.alias("line")))
    base = folder(spark)
    counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").option("path", f"{base}/counts").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{base}/counts").withColumn("start", F.col("start").cast("timestamp_ntz"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        doc_lines, format_scores, format_detect, record_assembly, level_infer, mask_templates, template_stats, severity_counts, redact_patterns, redact_shapes, redact_tokens, mask_shapes, record_shapes,
        selected, selected_max_lines, render_rows, reduce_output, reduce_json, reduce_blank, reduce_stats, written_texts, file_lines, hook_answers,
        *map(_fields_of, ("json", "logfmt", "klog", "syslog")), template_topk, document_frequency, blended_scores, entropy_tokens, synth_log, synth_templates,
        fingerprints, evidence_keys, signal_recall, recall_overall, reduction_manifest, reduction_sizes, tail_truncate, prompt_paths, stream_templates,
    )
}

_DOC = "l AS (SELECT doc_id::VARCHAR AS log_id, unnest(range(len(s))) AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"
_SCORES = r"""head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY pos) AS r FROM {lines} WHERE regexp_matches(line, '\S')) WHERE r <= 200),
scores AS (SELECT log_id, count(*) AS n, count(*) FILTER (ltrim(line) LIKE '{{%') AS json, count(*) FILTER (regexp_matches(line, '^[IWEF][0-9]')) AS klog,
  count(*) FILTER (regexp_matches(line, '^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)')) AS syslog, count(*) FILTER (contains(line, '=') AND NOT ltrim(line) LIKE '{{%') AS logfmt FROM head GROUP BY log_id)"""
_SEV = "CASE WHEN regexp_matches(upper({x}), 'PANIC|FATAL|CRITICAL') THEN 4 WHEN regexp_matches(upper({x}), 'ERROR|EXCEPTION|TRACEBACK|STACKTRACE') THEN 3 WHEN contains(upper({x}), 'WARN') THEN 2 WHEN contains(upper({x}), ' INFO ') OR contains(upper({x}), '[INFO]') THEN 1 ELSE 0 END"
_RECORDS = f"""WITH {logs.EVENTS_PLAIN_SQL},
marked AS (SELECT log_id, pos, line, sum(CASE WHEN line LIKE '    %' THEN 0 ELSE 1 END) OVER (PARTITION BY log_id ORDER BY pos) - 1 AS idx FROM lines),
recs AS (SELECT log_id, idx::BIGINT AS idx, string_agg(line, chr(10) ORDER BY pos) AS raw FROM marked GROUP BY log_id, idx)"""


def _mask_sql(x: str) -> str:
    for _, pattern, to in T.MASKS:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _redact_sql(x: str) -> str:
    for name, _, pattern, to in T.REDACTIONS:
        p, flags = pattern.replace("(?iU)", "").replace("(?U)", "").replace("(?!<REDACTED:)", "").replace("'", "''"), "gi" if "(?i" in pattern else "g"
        for i in range(1, 6):
            to = to.replace(f"${i}", f"\\{i}")
        x = f"regexp_replace({x}, '{p}', '{to}', '{flags}')"
    return x


_TEMPLATES = f"""{_RECORDS}, m AS (SELECT log_id, idx, raw, {_mask_sql('raw')} AS template FROM recs),
t AS (SELECT log_id, template, count(*) AS cnt, min(idx) AS first_idx FROM m GROUP BY ALL),
terms AS (SELECT log_id, template, term, count(*) AS tf FROM (SELECT log_id, template, unnest(string_split(template, ' ')) AS term FROM t) WHERE term <> '' GROUP BY ALL),
df AS (SELECT log_id, term, count(*) AS df FROM terms GROUP BY ALL), n AS (SELECT log_id, count(*) AS n FROM t GROUP BY log_id),
one AS (SELECT log_id, template, sum(round(tf * (ln(n / df) + 1), 9)) AS one FROM terms JOIN df USING (log_id, term) JOIN n USING (log_id) GROUP BY ALL)"""

ORACLE_SQL: dict[str, str] = {
    "doc_lines": rf"WITH {_DOC} SELECT log_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, '\S')) AS n_kept, sum(length(line))::BIGINT AS chars FROM l GROUP BY log_id",
    "format_scores": f"WITH {_DOC}, {_SCORES.format(lines='l')} SELECT * FROM scores",
    "format_detect": f"WITH {logs.EVENTS_PLAIN_SQL}, {_SCORES.format(lines='lines')} SELECT log_id, CASE WHEN json * 100 // n > 50 THEN 'json' WHEN klog * 100 // n > 30 THEN 'klog' WHEN syslog * 100 // n > 30 THEN 'syslog' WHEN logfmt * 100 // n > 30 THEN 'logfmt' ELSE 'plain' END AS format FROM scores",
    "record_assembly": f"{_RECORDS} SELECT log_id, idx, raw FROM recs",
    "level_infer": f"WITH {logs.EVENTS_PLAIN_SQL} SELECT log_id, {_SEV.format(x='line')} AS sev, count(*) AS n FROM lines GROUP BY ALL",
    "mask_templates": f"WITH {_DOC} SELECT log_id, pos, {_mask_sql('line')} AS template FROM l",
    "template_stats": f"{_TEMPLATES} SELECT log_id, template, cnt, first_idx, round(round(cnt * one, 6), 4) AS rarity FROM t JOIN one USING (log_id, template)",
    "severity_counts": f"{_RECORDS}, s AS (SELECT log_id, {_SEV.format(x='raw')} AS sev FROM recs) SELECT log_id, count(*) FILTER (sev = 0) AS other, count(*) FILTER (sev = 1) AS info, count(*) FILTER (sev = 2) AS warn, count(*) FILTER (sev = 3) AS error, count(*) FILTER (sev = 4) AS fatal FROM s GROUP BY log_id",
    "redact_patterns": f"SELECT doc_id, md5({_redact_sql('text')}) AS redacted_md5 FROM documents",
}

_RANK = "CASE WHEN upper({x}) IN ('FATAL','CRITICAL','PANIC','EMERG','ALERT') THEN 4 WHEN upper({x}) IN ('ERROR','ERR','E') THEN 3 WHEN upper({x}) IN ('WARN','WARNING','W') THEN 2 WHEN upper({x}) IN ('INFO','INFORMATION','I','NOTICE') THEN 1 ELSE 0 END"
_LEVEL_KEY = "CASE WHEN json_type(line, '$.level') IS NOT NULL THEN '$.level' WHEN json_type(line, '$.severity') IS NOT NULL THEN '$.severity' ELSE '$.lvl' END"
_FIELDS = {
    "json": (_RANK.format(x=f"CASE WHEN json_type(line, {_LEVEL_KEY}) = 'VARCHAR' THEN json_extract_string(line, {_LEVEL_KEY}) END"), "CASE WHEN json_type(line, '$.ts') = 'UBIGINT' THEN json_extract_string(line, '$.ts')::BIGINT END"),
    "logfmt": (f"CASE WHEN regexp_matches(line, '(?:^|\\s)level=') THEN {_RANK.format(x="trim(regexp_extract(line, '(?:^|\\s)level=(\\S*)', 1), '\"')")} ELSE {_SEV.format(x='line')} END", "NULL::BIGINT"),
    "klog": ("CASE line[1] WHEN 'I' THEN 1 WHEN 'W' THEN 2 WHEN 'E' THEN 3 WHEN 'F' THEN 4 ELSE 0 END", "NULL::BIGINT"),
    "syslog": (_SEV.format(x="line"), "NULL::BIGINT"),
}
for _kind, (_level, _ts) in _FIELDS.items():
    ORACLE_SQL[f"{_kind}_fields"] = f"WITH {logs.events_as_sql(_kind)}, f AS (SELECT log_id, {_level} AS sev, {_ts} AS ts FROM lines) SELECT log_id, '{_kind}' AS format, sev, count(*) AS n, min(ts) AS ts_min, max(ts) AS ts_max FROM f GROUP BY log_id, sev"


def _scores_sql(redacted: str = "raw", records: str = _RECORDS, sev: str | None = None) -> str:
    """Records with templates and scores, each template's best record marked (``best``), up to what was redacted."""
    return f"""{_TEMPLATES.replace(_RECORDS, records).replace("WITH", "WITH RECURSIVE", 1).replace("SELECT log_id, idx, raw, " + _mask_sql("raw"), f"SELECT log_id, idx, raw, {redacted} AS redacted, {_mask_sql(redacted)}")},
tm AS (SELECT log_id, template, cnt, round(cnt * one, 6) AS rarity, max(round(cnt * one, 6)) OVER (PARTITION BY log_id) AS most FROM t JOIN one USING (log_id, template)),
sc AS (SELECT *, round(0.4::DOUBLE * coalesce(rarity / nullif(most, 0), 0) + 0.5::DOUBLE * CASE sev WHEN 4 THEN 1.0 WHEN 3 THEN 0.9 WHEN 2 THEN 0.6 WHEN 1 THEN 0.2 ELSE 0.1 END::DOUBLE + 0.1::DOUBLE * (cnt = 1)::INT, 9) AS score
  FROM (SELECT *, {sev or _SEV.format(x="raw")} AS sev, ceil(length(raw) / 4)::BIGINT AS tokens FROM m) JOIN tm USING (log_id, template)),
best AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY log_id, template ORDER BY score DESC, idx) = 1 AS one FROM sc)"""


def _selected_sql(redacted: str = "raw", budget: int = 2000, context: int = 2, max_lines: int = 2**62, records: str = _RECORDS, sev: str | None = None) -> str:
    """Selection as the plain loops over ranked extras, then over context."""
    return f"""{_scores_sql(redacted, records, sev)},
cand AS MATERIALIZED (SELECT log_id, idx, tokens, row_number() OVER (PARTITION BY log_id ORDER BY score DESC, idx) AS k FROM best WHERE NOT one AND sev >= 3),
fill(log_id, k, idx, used, lines, take) AS (SELECT log_id, 0::BIGINT, -1::BIGINT, sum(tokens)::BIGINT, count(*), false FROM best WHERE one GROUP BY log_id
  UNION ALL SELECT f.log_id, c.k, c.idx, f.used + CASE WHEN f.used + c.tokens <= {budget} THEN c.tokens ELSE 0 END, f.lines + (f.used + c.tokens <= {budget})::INT, f.used + c.tokens <= {budget}
  FROM fill f JOIN cand c ON c.log_id = f.log_id AND c.k = f.k + 1 WHERE f.used < {budget} AND 2 * f.used <= {budget} AND f.lines < {max_lines}),
two AS (SELECT b.*, b.one OR coalesce(f.take, false) AS main FROM best b LEFT JOIN fill f USING (log_id, idx)),
near AS (SELECT *, max(main::INT) OVER (PARTITION BY log_id ORDER BY idx ROWS BETWEEN {context} PRECEDING AND {context} FOLLOWING) AS near FROM two),
ctx AS MATERIALIZED (SELECT log_id, idx, tokens, row_number() OVER (PARTITION BY log_id ORDER BY idx) AS k FROM near WHERE near = 1 AND NOT main),
fold(log_id, k, idx, room, take) AS (SELECT log_id, 0::BIGINT, -1::BIGINT, ({budget} - sum(tokens) FILTER (main))::BIGINT, false FROM two GROUP BY log_id
  UNION ALL SELECT f.log_id, c.k, c.idx, f.room - CASE WHEN c.tokens <= f.room THEN c.tokens ELSE 0 END, c.tokens <= f.room FROM fold f JOIN ctx c ON c.log_id = f.log_id AND c.k = f.k + 1 WHERE f.room > 0),
sel AS (SELECT t.*, coalesce(f.take, false) AS as_context, t.main OR coalesce(f.take, false) AS kept FROM two t LEFT JOIN fold f USING (log_id, idx))"""


_RENDER = """,
k AS (SELECT *, lag(idx, 1, -1) OVER (PARTITION BY log_id ORDER BY idx) AS prev, row_number() OVER (PARTITION BY log_id, template ORDER BY idx) = 1 AS first, string_split(CASE WHEN redacted = '' THEN raw ELSE redacted END, chr(10)) AS l FROM sel WHERE kept),
rows AS (SELECT log_id, idx * 2 + 1 AS ord, CASE WHEN as_context THEN 'context' ELSE 'line' END AS kind,
    array_to_string(list_concat([l[1] || CASE WHEN first AND cnt > 1 THEN '   (×' || cnt || ')' ELSE '' END || CASE WHEN as_context THEN '  ·' ELSE '' END], l[2:]), chr(10)) AS text FROM k
  UNION ALL SELECT log_id, idx * 2, 'gap', '… ' || (idx - prev - 1) || ' lines omitted' || CASE WHEN prev >= 0 THEN ' (from line ' || (prev + 1) || ')' ELSE '' END || ' …' FROM k WHERE idx - prev > 1
  UNION ALL SELECT log_id, n * 2, 'gap', '… ' || (n - 1 - m) || ' lines omitted (from line ' || (m + 1) || ') …' FROM (SELECT log_id, count(*) AS n, max(idx) FILTER (kept) AS m FROM sel GROUP BY log_id) WHERE n - 1 > m)"""
def _output(span: str = "''") -> str:
    """Headers and texts; ``span``: what the first line ends with."""
    return f""",
top AS (SELECT log_id, string_agg('"' || template || '" ×' || cnt, ' ; ' ORDER BY cnt DESC, rarity DESC, template) AS top FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY cnt DESC, rarity DESC, template) AS r FROM tm) WHERE r <= 5 GROUP BY log_id),
heads AS (SELECT log_id, count(*) AS n, count(*) FILTER (kept) AS kept, ceil(sum(strlen(raw)) / 4)::BIGINT AS it, count(*) FILTER (sev = 4) AS s4, count(*) FILTER (sev = 3) AS s3, count(*) FILTER (sev = 2) AS s2, count(*) FILTER (sev = 1) AS s1, count(*) FILTER (sev = 0) AS s0, {span} AS span FROM sel GROUP BY log_id),
texts AS (SELECT log_id, '# LOG SUMMARY  |  ' || n || ' lines → ' || kept || ' kept (' || (kept * 100 // n) || '%)' || span || chr(10) || '# levels: FATAL ' || s4 || '  ERROR ' || s3 || '  WARN ' || s2 || '  INFO ' || s1 || '  OTHER ' || s0 || chr(10)
    || '# top templates: ' || top || chr(10) || '{R.NOTE}' || chr(10) AS header, body, n, kept, it
  FROM heads JOIN top USING (log_id) JOIN (SELECT log_id, string_agg(text, chr(10) ORDER BY ord) || chr(10) AS body FROM rows GROUP BY log_id) USING (log_id))"""


_OUTPUT = _output()
_SQUEEZED = f"trim(regexp_replace({_redact_sql('raw')}, '\\s+', ' ', 'g'))"
_FINGERPRINT = r"trim(regexp_replace(trim(regexp_replace(regexp_replace({x}, '\x1b\[[0-9;]*m|\x1b\[K', '', 'g'), '^\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}\.\d+Z\s*', '')), '\s+', ' ', 'g'))"
_KEY = _FINGERPRINT.format(x="line")
_SIGNALS = f"""numbered AS (SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY pos) - 1 AS pos, line FROM lines),
signals AS (SELECT log_id, pos AS signal, CASE WHEN pos % 3 = 0 THEN 'critical' ELSE 'important' END AS importance FROM numbered WHERE contains(line, ' ERROR ')),
keys AS (SELECT DISTINCT s.log_id, s.signal, {_KEY}[1:60] AS key FROM signals s JOIN numbered n ON n.log_id = s.log_id AND n.pos BETWEEN s.signal AND s.signal + 2 WHERE length({_KEY}) >= 12)"""
_RECALL = f"""{_selected_sql()}{_RENDER}{_OUTPUT}, {_SIGNALS},
plain AS (SELECT log_id, header || chr(10) || body AS text FROM texts), hits AS (SELECT s.log_id, s.signal, s.importance, coalesce(bool_or(contains(p.text, k.key)), false) AS hit FROM signals s JOIN plain p USING (log_id) LEFT JOIN keys k USING (log_id, signal) GROUP BY ALL),
shares AS (SELECT log_id, count(*) AS raw_lines FROM lines GROUP BY log_id),
keeps AS (SELECT log_id, count(*) FILTER (NOT x LIKE '#%' AND NOT x LIKE '…%') AS kept_lines FROM (SELECT log_id, unnest(string_split(rtrim(text, chr(10)), chr(10))) AS x FROM plain) GROUP BY log_id),
sums AS (SELECT log_id, count(*) FILTER (importance = 'critical' AND hit) AS ch, count(*) FILTER (importance = 'critical') AS ct, count(*) FILTER (importance = 'important' AND hit) AS ih, count(*) FILTER (importance = 'important') AS n FROM hits GROUP BY log_id),
report AS (SELECT log_id, raw_lines, kept_lines, CASE WHEN coalesce(ct, 0) = 0 THEN 1.0 ELSE round(ch / ct, 3) END::DOUBLE AS critical_recall, coalesce(ch, 0) AS critical_hits, coalesce(ct, 0) AS critical_total,
  CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE round(ih / n, 3) END::DOUBLE AS important_recall, coalesce(ih, 0) AS important_hits, coalesce(n, 0) AS important_total, round(kept_lines / raw_lines * 100, 1) AS keep_pct, '?' AS failure_category
  FROM shares JOIN keeps USING (log_id) LEFT JOIN sums USING (log_id))"""
_SIZES = f"""{_selected_sql()}{_RENDER}{_OUTPUT},
raw_sizes AS (SELECT log_id, count(*) AS raw_lines, sum(strlen(line) + 1)::BIGINT AS raw_bytes FROM lines GROUP BY log_id),
both_sizes AS (SELECT log_id, raw_lines, raw_bytes, len(string_split(regexp_replace(header || chr(10) || body, '\\n\\z', ''), chr(10)))::BIGINT AS reduced_lines, strlen(header || chr(10) || body)::BIGINT AS reduced_bytes FROM raw_sizes JOIN texts USING (log_id))"""
_ASKED = r"""WITH f AS (SELECT '/logs/' || doc_id || '.txt' AS path, text, len(string_split(text, chr(10))) AS pieces, len(string_split(regexp_replace(text, '\n\z', ''), chr(10))) AS n_lines FROM documents),
p AS (SELECT conv_id || '-' || turn AS prompt_id, regexp_extract_all(text || ' see ./none.txt and /logs/' || conv_id || '.txt or /logs/' || (conv_id + turn) || '.txt', '(?m)(?:^|\s)((?:/|\.\.?/|~/|[A-Z]:\\)[\w./\\-]+)', 1) AS ps FROM conversations),
u AS (SELECT prompt_id, unnest(ps) AS path, unnest(range(len(ps))) AS nth FROM p), found AS (SELECT prompt_id, arg_min(path, nth) AS path, arg_min(n_lines, nth) AS n_lines, arg_min(text, nth) AS text FROM u JOIN f USING (path) WHERE pieces >= 5 GROUP BY prompt_id)"""
_TEXTS = "SELECT log_id, header, body, n AS input_records, kept AS kept_records, it AS input_tokens, ceil((strlen(header) + strlen(body)) / 4)::BIGINT AS output_tokens FROM texts"
_SYNTH = f"""WITH recs AS (SELECT 'bench' AS log_id, i AS idx, '2024-01-01T00:00:' || lpad((i % 60)::VARCHAR, 2, '0') || CASE WHEN i % 200 = 0 THEN ' ERROR failed to acquire connection id=' || i WHEN i % 100 = 0 THEN ' WARN pool at capacity ' || i WHEN i % 20 = 0 THEN ' INFO request ' || i || ' done in ' || (i % 500) || 'ms' ELSE ' INFO health check ok' END AS raw FROM range({SYNTHETIC}) r(i))"""
_JSON_FIELDS = [x.replace("line", "raw") for x in _FIELDS["json"]]
_JSON = f"""WITH {logs.events_as_sql("json")}, recs AS (SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY pos) - 1 AS idx, line AS raw FROM lines)"""
_JSON_SPAN = f"CASE WHEN max({_JSON_FIELDS[1]}) IS NULL THEN '' ELSE ' | epoch ' || min({_JSON_FIELDS[1]}) || '–' || max({_JSON_FIELDS[1]}) END"

ORACLE_SQL |= {
    "template_topk": f"{_TEMPLATES}, r AS (SELECT log_id, template, cnt, row_number() OVER (PARTITION BY log_id ORDER BY cnt DESC, round(cnt * one, 6) DESC, template) AS r FROM t JOIN one USING (log_id, template)) SELECT log_id, r, template, cnt FROM r WHERE r <= 5",
    "document_frequency": f"{_TEMPLATES} SELECT * FROM df",
    "blended_scores": f"{_scores_sql()} SELECT log_id, idx, round(score, 6) AS score FROM sc",
    "selected": f"{_selected_sql()} SELECT log_id, idx, template, as_context FROM sel WHERE kept",
    "render_rows": f"{_selected_sql()}{_RENDER} SELECT log_id, ord, kind, text FROM rows",
    "reduce_output": f"{_selected_sql(_SQUEEZED)}{_RENDER}{_OUTPUT} {_TEXTS}",
    "entropy_tokens": r"WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS token FROM documents), c AS (SELECT doc_id, token, unnest(string_split(token, '')) AS c FROM t WHERE token <> ''), n AS (SELECT doc_id, token, c, count(*) / any_value(strlen(token)) AS p FROM c GROUP BY doc_id, token, c) SELECT doc_id, token, coalesce(round(sum(-p * log2(p)) FILTER (ascii(c) < 128), 6), 0) AS bits FROM n GROUP BY ALL",
    "synth_log": f"{_selected_sql(records=_SYNTH)}{_RENDER}{_OUTPUT} {_TEXTS}",
    "synth_templates": f"{_SYNTH}, m AS (SELECT idx, {_mask_sql('raw')} AS template FROM recs) SELECT template, count(*) AS cnt, min(idx) AS first_idx FROM m GROUP BY 1",
    "reduce_json": f"{_selected_sql(records=_JSON, sev=_JSON_FIELDS[0])}{_RENDER}{_output(_JSON_SPAN)} {_TEXTS}",
    "reduce_blank": f"""SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS log_id, '# LOG SUMMARY  |  0 lines → 0 kept (0%)' || chr(10) || '# levels: FATAL 0  ERROR 0  WARN 0  INFO 0  OTHER 0' || chr(10) || '{R.NOTE}' || chr(10) AS header,
  '' AS body, 0::BIGINT AS input_records, 0::BIGINT AS kept_records, 0::BIGINT AS input_tokens, ceil(strlen(header) / 4)::BIGINT AS output_tokens FROM events""",
    "selected_max_lines": f"{_selected_sql(max_lines=MAX_LINES)} SELECT log_id, idx, template, as_context FROM sel WHERE kept",
    "redact_shapes": f"WITH {logs.shapes_sql(logs.SECRETS)} SELECT event_id, {_redact_sql('line')} AS redacted FROM shapes",
    "mask_shapes": f"WITH {logs.shapes_sql(logs.SHAPES)} SELECT event_id, {_mask_sql('line')} AS template FROM shapes",
    "redact_tokens": rf"""WITH {logs.shapes_sql(logs.TOKENS)},
t AS (SELECT event_id, unnest(range(len(l))) AS i, unnest(l) AS token FROM (SELECT event_id, string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ') AS l FROM shapes)),
c AS (SELECT *, regexp_replace(token, '^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$', '', 'g') AS core FROM t),
e AS (SELECT core, round(sum(-p * log2(p)), 9) AS bits FROM (SELECT core, x, count(*) / any_value(strlen(core)) AS p FROM (SELECT core, unnest(string_split(core, '')) AS x FROM (SELECT DISTINCT core FROM c WHERE core <> '')) GROUP BY core, x) GROUP BY core)
SELECT event_id, string_agg(CASE WHEN strlen(core) >= 20 AND regexp_full_match(core, '[a-zA-Z0-9+/=_-]*') AND bits >= 3.5 THEN replace(token, core, '<REDACTED:hi>') ELSE token END, ' ' ORDER BY i) AS redacted FROM c LEFT JOIN e USING (core) GROUP BY event_id""",
    "record_shapes": f"""WITH {logs.EVENTS_FRAMED_SQL},
marked AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY pos) - 1 AS idx FROM lines),
recs AS (SELECT format, log_id, idx::BIGINT AS idx, string_agg(line, chr(10) ORDER BY pos) AS raw, count(*) AS n, min(line) FILTER (starts) AS line, min(CASE WHEN format = 'json' AND starts THEN line ELSE '{{}}' END) FILTER (starts) AS js FROM marked GROUP BY ALL)
SELECT log_id, idx, format, md5(raw) AS raw_md5, CASE WHEN format = 'json' AND n = 1 THEN {_JSON_FIELDS[0].replace("raw", "js")} WHEN format = 'klog' THEN {_FIELDS["klog"][0]}
    WHEN format = 'logfmt' AND regexp_matches(raw, '(?:^|\\s)(?:level|lvl|severity)=') THEN {_RANK.format(x="trim(regexp_extract(raw, '(?:^|\\s)(?:level|lvl|severity)=(\\S*)', 1), '\"')")} ELSE {_SEV.format(x="raw")} END AS sev,
  CASE WHEN format = 'json' AND n = 1 THEN {_JSON_FIELDS[1].replace("raw", "js")} END AS ts,
  CASE WHEN format = 'json' AND n = 1 THEN json_extract_string(js, '$.msg') WHEN format = 'klog' THEN regexp_replace(substr(raw, instr(raw, ']') + 1), '^\\s+|\\s+$', '', 'g') ELSE raw END AS message FROM recs""",
    "fingerprints": f"WITH {_DOC} SELECT log_id, pos, CASE WHEN length({_KEY}) >= 12 THEN {_KEY} END AS fingerprint FROM l",
    "evidence_keys": f"WITH {logs.EVENTS_PLAIN_SQL}, {_SIGNALS} SELECT * FROM keys",
    "signal_recall": f"{_RECALL} SELECT * FROM report",
    "recall_overall": f"{_RECALL} SELECT count(*) AS cases, round(avg(critical_recall), 6) AS avg_critical_recall, sum(critical_hits)::BIGINT AS critical_hits, sum(critical_total)::BIGINT AS critical_total, round(avg(keep_pct), 6) AS avg_keep_pct FROM report",
    "reduction_manifest": f"""{_SIZES} SELECT log_id AS case_id, 'siltwork-2k' AS method, 'context_provider' AS mode, log_id || '/raw.log' AS raw_log_path, log_id || '.txt' AS context_path, raw_lines AS input_line_count, reduced_lines AS output_line_count,
  raw_bytes AS input_byte_size, reduced_bytes AS output_byte_size, round(1 - reduced_lines / raw_lines, 6) AS reduction_ratio, 0 AS ranges, 2000 AS budget_tokens, 'siltwork' AS binary FROM both_sizes""",
    "reduction_sizes": f"{_SIZES} SELECT *, round((1 - reduced_lines / raw_lines) * 100, 1) AS line_reduction_pct, round((1 - reduced_bytes / raw_bytes) * 100, 1) AS byte_reduction_pct FROM both_sizes",
    "tail_truncate": f"""WITH {_DOC}, h AS (SELECT log_id, pos, CASE WHEN pos % 5 = 0 THEN '# ' || line ELSE line END AS x FROM l),
b AS (SELECT *, x LIKE '#%' AS head, strlen(x) + 1 AS n FROM h), s AS (SELECT log_id, sum(n) AS total, coalesce(sum(n) FILTER (head), 0) AS heads FROM b GROUP BY log_id),
e AS (SELECT b.*, total > 600 AS long, heads, sum(n) OVER (PARTITION BY log_id, head ORDER BY pos DESC) AS tail FROM b JOIN s USING (log_id)),
o AS (SELECT log_id, CASE WHEN long AND NOT head THEN 2 ELSE 0 END AS part, pos, x FROM e WHERE NOT long OR head OR tail <= 600 - heads
  UNION ALL SELECT log_id, 1, 0, '… ' || count(*) FILTER (NOT head AND tail > 600 - heads) || ' lines truncated (context too large for LLM) …' FROM e WHERE long GROUP BY log_id)
SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY part, pos) - 1 AS ord, x AS text FROM o""",
    "prompt_paths": f"{_ASKED} SELECT prompt_id, path, n_lines FROM found",
    "hook_answers": rf"""{_ASKED} SELECT conv_id || '-' || turn AS prompt_id, CASE WHEN path IS NOT NULL THEN 'UserPromptSubmit' END AS event,
  md5('siltwork hook: `' || path || '` is a log of ' || n_lines || ' lines. Work from its reduced form below instead of the raw file; for more detail, run `python -m siltwork ' || path || ' --context 5` or raise `--budget`.' || chr(10)
    || '--- LOG (reduced from ' || n_lines || ' lines) ---' || chr(10) || found.text || chr(10) || '---' || chr(10)) AS context_md5
FROM conversations LEFT JOIN found ON prompt_id = conv_id || '-' || turn""",
    "reduce_stats": f"""{_selected_sql()}{_RENDER}{_OUTPUT}, out AS ({_TEXTS}) SELECT log_id, input_records || ' lines → ' || kept_records || ' kept | tokens ' || input_tokens || ' → ' || output_tokens || ' (' || printf('%.1f', output_tokens / input_tokens * 100) || '%)' AS stats FROM out""",
    "written_texts": f"{_selected_sql()}{_RENDER}{_OUTPUT} SELECT log_id, md5(regexp_replace(header || chr(10) || body, '\\n\\z', '')) AS text_md5 FROM texts",
    "file_lines": f"WITH {logs.EVENTS_PLAIN_SQL} SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY pos) - 1 AS pos, line FROM lines",
    "stream_templates": f"""WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, 'event ' || event_id || ' ' || upper(event_type) AS line FROM events)
SELECT start, {_mask_sql('line')} AS template, {_SEV.format(x='line')} AS sev, count(*) AS n FROM e WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL""",
}
