"""Log reduction: records, templates, scores, budgeted selection, rendering; many logs at once, by ``log_id``.

A log may be as large as all others together: lines are numbered in blocks, and what is sorted by log is bounded by the
budget, or one row a template. Records are written once; all that follows reads the columns it needs of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltwork.config import ReduceConfig
from siltwork.functions import text as T
from siltwork.sources.store import stored

MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
HEAD = 200
# Fixed value: the last line of a header.
NOTE = "# Note: token counts use tiktoken cl100k_base — slightly conservative for Claude."


def not_blank(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line").rlike(r"(?U)\S"))


def line_kinds(line):
    is_json = F.regexp_replace(line, r"(?U)^\s+", "").startswith("{")
    return {"json": is_json, "klog": line.rlike("^[IWEF][0-9]"), "syslog": line.rlike(f"^(?:{MONTHS})"), "logfmt": line.contains("=") & ~is_json}


def format_scores(lines: DataFrame) -> DataFrame:
    """Per log, over its first lines that are not blank: how many there are and how many look like each format."""
    head = not_blank(lines).withColumn("r", F.row_number().over(Window.partitionBy("log_id").orderBy("pos"))).where(F.col("r") <= HEAD)
    return head.groupBy("log_id").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in line_kinds(F.col("line")).items()])


def detect_format(lines: DataFrame) -> DataFrame:
    out = None
    for k, least in (("json", 50), ("klog", 30), ("syslog", 30), ("logfmt", 30)):
        hit = F.floor(F.col(k) * 100 / F.col("n")) > least
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return format_scores(lines).select("log_id", out.otherwise("plain").alias("format"))


def _by_format(of: dict, otherwise):
    """The value of ``of`` that the format has, by name."""
    out = None
    for name, value in of.items():
        out = F.when(F.col("format") == name, value) if out is None else out.when(F.col("format") == name, value)
    return out.otherwise(otherwise)


def records(lines: DataFrame, fmt: str = "auto", block: int = 100_000) -> DataFrame:
    """``log_id, idx, format, raw``: lines with their continuations, numbered from 0.

    Numbers are a two-level prefix sum over blocks of positions, so that one huge log is not one task: a first pass counts
    the starts of records in each block by the rule of every format, a look at the first blocks finds the format. Lines
    without a continuation are records as they are; only the others are gathered.
    """
    lines = not_blank(lines).withColumn("block", F.floor(F.col("pos") / block))
    k = line_kinds(F.col("line"))
    rules = {"json": k["json"], "klog": k["klog"], "syslog": k["syslog"], "other": ~F.col("line").rlike("^(?:    |\t)")}
    sums = [x for name, c in rules.items() for x in (F.count_if(c).alias(f"n_{name}"), F.min(F.when(c, F.col("pos"))).alias(f"first_{name}"))]
    blocks = lines.groupBy("log_id", "block").agg(F.count("*").alias("n"), F.min("pos").alias("first"), *sums)
    blocks = stored(blocks, "blocks")  # a row for each block, with a size that Spark knows
    before = Window.partitionBy("log_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("lines", F.coalesce(F.sum("n").over(before), F.lit(0)))
    if fmt == "auto":
        head = lines.join(stored(blocks.where(F.col("lines") < HEAD).select("log_id", "block"), "head"), ["log_id", "block"], "left_semi")
        blocks = blocks.join(detect_format(head), "log_id")
    else:
        blocks = blocks.withColumn("format", F.lit(fmt))
    named = {name: name for name in ("json", "klog", "syslog")}
    of = lambda column: _by_format({n: F.col(column(n)) for n in named}, F.col(column("other")))
    # a log's first line starts a record, whatever it looks like
    blocks = blocks.withColumn("s", of(lambda n: f"n_{n}") + ((F.col("lines") == 0) & ~F.coalesce(of(lambda n: f"first_{n}") == F.col("first"), F.lit(False))).cast("long"))
    blocks = blocks.select("log_id", "block", "format", F.when(F.col("lines") == 0, F.col("first")).alias("first"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    d = lines.join(stored(blocks, "starts"), ["log_id", "block"])
    starts = _by_format({n: rules[n] for n in named}, rules["other"])
    d = d.withColumn("start", (starts | F.coalesce(F.col("pos") == F.col("first"), F.lit(False))).cast("long")).drop("first")
    w = Window.partitionBy("log_id", "block").orderBy("pos")
    d = d.withColumn("idx", F.col("base") + F.sum("start").over(w) - 1).withColumn("next", F.lead("start").over(w))
    alone = (F.col("start") == 1) & F.coalesce(F.col("next") == 1, F.lit(False))
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    several = d.where(~alone).groupBy("log_id", "format", "idx").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("raw"))
    return d.where(alone).select("log_id", "format", "idx", F.col("line").alias("raw")).unionByName(several)


def fields(recs: DataFrame) -> DataFrame:
    """``sev``, ``ts`` and ``message`` by format; JSON that does not parse follows the plain rule, whose message is the record."""
    raw, inferred = F.col("raw"), T.infer_severity(F.col("raw"))
    wrapped = F.concat(F.lit("["), raw, F.lit("]"))
    v = F.expr("try_parse_json(concat('[', raw, ']'))")
    d = recs.withColumn("__v", F.when((F.col("format") == "json") & wrapped.isNotNull(), v))
    d = d.withColumn("__v", F.when(F.expr("try_variant_get(__v, '$[1]', 'variant') IS NULL"), F.expr("try_variant_get(__v, '$[0]', 'variant')")))
    kind = lambda key: f"schema_of_variant(try_variant_get(__v, '$.{key}', 'variant'))"
    text = lambda key, of: f"CASE WHEN {kind(key)} = '{of}' THEN try_variant_get(__v, '$.{key}', 'string') END"
    pick = lambda keys, of: F.expr("CASE " + " ".join(f"WHEN try_variant_get(__v, '$.{k}', 'variant') IS NOT NULL THEN {text(k, of)}" for k in keys) + " END")
    logfmt = F.regexp_extract("raw", r"(?U)(?:^|\s)(?:level|lvl|severity)=(\S*)", 1)
    has = raw.rlike(r"(?U)(?:^|\s)(?:level|lvl|severity)=")
    klog = F.when(F.substring("raw", 1, 1) == "I", 1).when(F.substring("raw", 1, 1) == "W", 2).when(F.substring("raw", 1, 1) == "E", 3).when(F.substring("raw", 1, 1) == "F", 4).otherwise(0)
    sev = (
        F.when((F.col("format") == "json") & F.col("__v").isNotNull(), T.level_rank(pick(("level", "severity", "lvl"), "STRING")))
        .when(F.col("format") == "klog", klog)
        .when((F.col("format") == "logfmt") & has, T.level_rank(F.regexp_replace(logfmt, '^"+|"+$', "")))
        .otherwise(inferred)
    )
    ts = F.when(F.col("format") == "json", pick(("timestamp", "time", "ts"), "BIGINT").cast("long"))
    said = F.when(F.col("format") == "json", pick(("message", "msg", "text"), "STRING")).when((F.col("format") == "klog") & raw.contains("]"), T.trim(F.expr("substring(raw, instr(raw, ']') + 1)")))
    return d.select(*recs.columns, sev.cast("tinyint").alias("sev"), ts.alias("ts"), F.coalesce(said, raw).alias("message"))


def templated(recs: DataFrame, cfg: ReduceConfig) -> DataFrame:
    """With ``redacted``, ``template``, its 64-bit ``template_id``, and ``tokens``, at least 1."""
    redacted = T.redact(F.col("raw")) if cfg.redact else F.col("raw")
    d = recs.withColumn("redacted", redacted).withColumn("template", T.mask(F.col("redacted")))
    return d.withColumn("template_id", F.xxhash64("template")).withColumn("tokens", F.greatest(cfg.tokens(F.col("raw")), F.lit(1)).cast("long"))


def templates(recs: DataFrame, cfg: ReduceConfig | None = None) -> DataFrame:
    """``log_id, template, cnt, first_idx, best, rarity``; terms are counted on distinct templates and weighed by count.

    ``best``: ``idx`` of the record with the highest score, the first of several. Records of a template differ in severity only.
    """
    cfg = cfg or ReduceConfig()
    low = [F.min(F.when(F.col("sev") == r, F.col("idx"))).alias(f"idx{r}") for r in range(len(T.WEIGHTS))]
    t = recs.groupBy("log_id", "template").agg(F.count("*").alias("cnt"), *low)
    # of the severities that weigh most, the first record
    weigh = {r: round(cfg.weights[1] * x, 9) for r, x in enumerate(T.WEIGHTS)}
    best = [F.array_min(F.array(*[F.col(f"idx{r}") for r in weigh if weigh[r] == x])) for x in sorted(set(weigh.values()), reverse=True)]
    t = t.select("log_id", "template", "cnt", F.array_min(F.array(*[F.col(f"idx{r}") for r in weigh])).alias("first_idx"), F.coalesce(*best).alias("best"))
    terms = t.select("log_id", "template", F.explode(F.split("template", " ")).alias("term")).where("term <> ''").groupBy("log_id", "template", "term").agg(F.count("*").alias("tf"))
    df = terms.groupBy("log_id", "term").agg(F.count("*").alias("df"))
    n = t.groupBy("log_id").agg(F.count("*").alias("n"))
    scored = terms.join(df, ["log_id", "term"]).join(n, "log_id").withColumn("w", F.round(F.col("tf") * (F.log(F.col("n") / F.col("df")) + 1), 9))
    # summed in the order of terms, whatever the shuffle did
    total = scored.groupBy("log_id", "template").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("l")).select("log_id", "template", F.aggregate("l", F.lit(0.0), lambda a, x: a + x["w"]).alias("one"))
    return t.join(total, ["log_id", "template"], "left").select("log_id", "template", "cnt", "first_idx", "best", F.round(F.col("cnt") * F.coalesce("one", F.lit(0.0)), 6).alias("rarity"))


def scored(recs: DataFrame, tmpl: DataFrame, cfg: ReduceConfig) -> DataFrame:
    """``recs`` with ``cnt``, ``rarity``, ``best`` of their templates, and ``score``."""
    top = tmpl.groupBy("log_id").agg(F.max("rarity").alias("most"))
    r, s, b = cfg.weights
    d = recs.join(tmpl.join(top, "log_id"), ["log_id", "template"])
    score = r * F.coalesce(F.col("rarity") / F.nullif("most", F.lit(0.0)), F.lit(0.0)) + s * T.weight(F.col("sev")) + b * (F.col("cnt") == 1).cast("double")
    return d.withColumn("score", F.round(score, 9)).drop("most", "first_idx")


def select(recs: DataFrame, tmpl: DataFrame, cfg: ReduceConfig) -> DataFrame:
    """``log_id, idx, as_context`` of what is kept: each template's best record, then severe extras in half the budget, then context."""
    ones = stored(recs.select("log_id", "idx", "tokens").join(tmpl.select("log_id", F.col("best").alias("idx")), ["log_id", "idx"]), "ones")
    used = ones.groupBy("log_id").agg(F.sum("tokens").alias("u0"), F.count("*").alias("l0"))
    budget, most = F.lit(cfg.budget), F.lit(cfg.max_lines if cfg.max_lines is not None else 2**62)
    c = scored(recs.where(F.col("sev") >= 3).select("log_id", "idx", "template", "sev", "tokens"), tmpl, cfg).where(F.col("idx") != F.col("best"))
    c = c.join(used, "log_id").where((2 * F.col("u0") <= budget) & (F.col("u0") + F.col("tokens") <= budget)).select("log_id", "idx", "tokens", "score", "u0", "l0")
    # half the budget holds so many small ones at most, and of big ones of one size only the first can be the one that fits
    small = F.col("tokens") * 2 <= cfg.budget
    first = c.where(small).withColumn("r", F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("score"), "idx"))).where(F.col("r") <= cfg.budget // 2 + 1).drop("r")
    big = c.where(~small).groupBy("log_id", "tokens", "u0", "l0").agg(F.max_by(F.struct("idx", "score"), F.struct("score", -F.col("idx"))).alias("x"))
    c = first.unionByName(big.select("log_id", "x.idx", "tokens", "x.score", "u0", "l0"))
    before = Window.partitionBy("log_id").orderBy(F.desc("score"), "idx").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("s", F.coalesce(F.sum(F.when(small, F.col("tokens"))).over(before), F.lit(0))).withColumn("k", F.count(F.when(small, 1)).over(before))
    ok = (2 * (F.col("u0") + F.col("s")) <= budget) & (F.col("u0") + F.col("s") < budget) & (F.col("l0") + F.col("k") < most)
    c = c.withColumn("big", ~small & ok & (F.col("u0") + F.col("s") + F.col("tokens") <= budget)).withColumn("bigs", F.coalesce(F.sum(F.col("big").cast("int")).over(before), F.lit(0)))
    extra = c.where(((small & ok) | F.col("big")) & (F.col("bigs") == 0)).select("log_id", "idx", "tokens")
    main = stored(ones.unionByName(extra), "main")
    return main.select("log_id", "idx", F.lit(False).alias("as_context")).unionByName(_context(recs, main, cfg).withColumn("as_context", F.lit(True)))


def _context(recs: DataFrame, main: DataFrame, cfg: ReduceConfig) -> DataFrame:
    """``log_id, idx`` of records near ``main`` that still fit, in their order. A log with room has fewer kept records than budget."""
    left = main.groupBy("log_id").agg((F.lit(cfg.budget) - F.sum("tokens")).alias("left")).where("left > 0")
    around = F.sequence(F.col("idx") - cfg.context, F.col("idx") + cfg.context)
    near = main.join(left, "log_id").select("log_id", "left", F.explode(around).alias("idx")).distinct().join(main, ["log_id", "idx"], "left_anti")
    wanted = stored(near.join(recs.select("log_id", "idx", "tokens"), ["log_id", "idx"]), "near")
    wanted = wanted.join(wanted.groupBy("log_id").agg(F.sum("tokens").alias("total")), "log_id")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, room, take = pdf.sort_values("idx"), int(pdf["left"].iloc[0]), []
        for t in pdf["tokens"]:
            take.append(t <= room)
            room -= t if t <= room else 0
        return pdf.loc[take, ["log_id", "idx"]]

    # greedy with skips has no closed form; a log whose candidates all fit needs none, others fold at most the
    # candidates that could fit alone
    fits = wanted.where("total <= left").select("log_id", "idx")
    tight = wanted.where("total > left and tokens <= left").groupBy("log_id").applyInPandas(fill, "log_id string, idx long")
    return fits.unionByName(tight)


def header(logs: DataFrame, recs: DataFrame, tmpl: DataFrame, kept: DataFrame) -> DataFrame:
    """``log_id, header`` and the numbers in it, also of logs without records."""
    counts = [F.count_if(F.col("sev") == r).alias(T.LABELS[r].lower()) for r in range(5)]
    a = recs.groupBy("log_id").agg(F.count("*").alias("input_records"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"), F.ceil(F.sum(F.octet_length("raw")) / 4).alias("input_tokens"), *counts)
    w = Window.partitionBy("log_id").orderBy(F.desc("cnt"), F.desc("rarity"), "template")
    top = tmpl.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit('"'), "template", F.lit('" ×'), F.col("cnt").cast("string")).alias("t")))).alias("l"))
    a = logs.select("log_id").distinct().join(a, "log_id", "left").join(kept.groupBy("log_id").agg(F.count("*").alias("kept_records")), "log_id", "left")
    a = a.fillna(0, ["input_records", "kept_records", "input_tokens", *(x.lower() for x in T.LABELS)])
    a = a.join(top.select("log_id", F.array_join(F.transform("l", lambda x: x["t"]), " ; ").alias("top")), "log_id", "left")
    span = F.when(F.col("ts_min").isNotNull(), F.concat(F.lit(" | epoch "), F.col("ts_min").cast("string"), F.lit("–"), F.col("ts_max").cast("string"))).otherwise("")
    pct = F.floor(F.col("kept_records") * 100 / F.greatest("input_records", F.lit(1)))
    first = F.concat(F.lit("# LOG SUMMARY  |  "), F.col("input_records"), F.lit(" lines → "), F.col("kept_records"), F.lit(" kept ("), pct, F.lit("%)"), span)
    levels = F.concat(F.lit("# levels: "), *[x for r in (4, 3, 2, 1, 0) for x in (F.lit(("" if r == 4 else "  ") + T.LABELS[r] + " "), F.col(T.LABELS[r].lower()).cast("string"))])
    return a.withColumn("header", F.concat_ws("\n", first, levels, F.when(F.col("top").isNotNull(), F.concat(F.lit("# top templates: "), "top")), F.lit(NOTE), F.lit("")))


def render(recs: DataFrame, tmpl: DataFrame, kept: DataFrame) -> DataFrame:
    """``log_id, ord, kind, text``: gaps, then the kept record after each, in the order of records."""
    w = Window.partitionBy("log_id").orderBy("idx")
    k = recs.select("log_id", "idx", "raw", "redacted", "template").join(kept, ["log_id", "idx"]).join(tmpl.select("log_id", "template", "cnt"), ["log_id", "template"])
    k = k.withColumn("prev", F.lag("idx", 1, -1).over(w)).withColumn("first", F.row_number().over(Window.partitionBy("log_id", "template").orderBy("idx")) == 1)
    shown = F.split(F.when(F.col("redacted") == "", F.col("raw")).otherwise(F.col("redacted")), "\n")
    mark = F.when(F.col("as_context"), "  ·").otherwise("")
    many = F.when(F.col("first") & (F.col("cnt") > 1), F.concat(F.lit("   (×"), F.col("cnt").cast("string"), F.lit(")"))).otherwise("")
    text = F.concat_ws("\n", F.concat(F.get(shown, F.lit(0)), many, mark), F.when(F.size(shown) > 1, F.array_join(F.slice(shown, 2, F.size(shown)), "\n")))
    gap = lambda size, prev: F.concat(F.lit("… "), size.cast("string"), F.lit(" lines omitted"), F.when(prev >= 0, F.concat(F.lit(" (from line "), (prev + 1).cast("string"), F.lit(")"))).otherwise(""), F.lit(" …"))
    line = F.struct((F.col("idx") * 2 + 1).alias("ord"), F.when(F.col("as_context"), "context").otherwise("line").alias("kind"), text.alias("text"))
    before = F.struct((F.col("idx") * 2).alias("ord"), F.lit("gap").alias("kind"), gap(F.col("idx") - F.col("prev") - 1, F.col("prev")).alias("text"))
    lines = k.select("log_id", F.explode(F.when(F.col("idx") - F.col("prev") > 1, F.array(before, line)).otherwise(F.array(line))).alias("x")).select("log_id", "x.*")
    last = kept.groupBy("log_id").agg(F.max("idx").alias("m")).join(recs.groupBy("log_id").agg(F.count("*").alias("n")), "log_id").where("n - 1 > m")
    tail = last.select("log_id", (F.col("n") * 2).alias("ord"), F.lit("gap").alias("kind"), gap(F.col("n") - 1 - F.col("m"), F.col("m")).alias("text"))
    return lines.unionByName(tail)


@dataclass
class Reduced:
    """``records``, ``templates`` and ``kept`` are stored tables; the rest is made from them when it is asked for."""

    records: DataFrame
    templates: DataFrame
    kept: DataFrame
    rows: DataFrame
    headers: DataFrame

    @property
    def selected(self) -> DataFrame:
        """All records with ``kept`` and ``as_context``."""
        d = self.records.join(self.kept.withColumn("kept", F.lit(True)), ["log_id", "idx"], "left")
        return d.fillna(False, ["kept", "as_context"])

    def output(self) -> DataFrame:
        """One row a log: header, body and token counts. A body is as large as its kept records, and empty where there are none."""
        body = self.rows.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("l")).select("log_id", F.concat(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), F.lit("\n")).alias("body"))
        d = self.headers.join(body, "log_id", "left").withColumn("body", F.coalesce("body", F.lit("")))
        return d.select("log_id", "header", "body", "input_records", "kept_records", "input_tokens", F.ceil((F.octet_length("header") + F.octet_length("body")) / 4).alias("output_tokens"))


def reduce_logs(lines: DataFrame, cfg: ReduceConfig | None = None) -> Reduced:
    """Reduce each log of ``lines``. A log without a line that is not blank gets a header only; an empty table has no logs."""
    cfg = cfg or ReduceConfig()
    recs = stored(templated(fields(records(lines, cfg.format)).drop("message"), cfg), "records")
    tmpl = stored(templates(recs, cfg), "templates")
    kept = stored(select(recs, tmpl, cfg), "kept")
    return Reduced(recs, tmpl, kept, render(recs, tmpl, kept), header(lines, recs, tmpl, kept))
