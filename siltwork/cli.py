"""The command line: reduce a log, answer a prompt's hook, evaluate cases.

    python -m siltwork app.log --budget 4000 --stats
    python -m siltwork hook < prompt.json
    python -m siltwork evaluate cases/ --budget 2000

Exit codes: 0, 1 for options that cannot be, 2 for files that cannot be read or written. The hook never fails: what goes wrong is ``{}``.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltwork.config import ReduceConfig, format_of, weights_of
from siltwork.operators import evaluate as E
from siltwork.operators.reduce import NOTE, reduce_logs
from siltwork.sources import cases, logs, prompts, sinks

#: Options whose next argument is their value.
VALUED = ("-o", "--out", "-b", "--budget", "--max-lines", "-c", "--context", "--format", "--weights", "--tokenizer", "--split")


def rejoin(args: Sequence[str], exists: Callable[[str], bool] = os.path.exists) -> list[str]:
    """``args`` with each run of bare words that together name an existing path as one argument: a path with spaces, unquoted."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        whole = " ".join(run)
        out.extend([whole] if len(run) > 1 and exists(whole) else run)
        run.clear()

    valued = False
    for a in args:
        if valued or a.startswith("-"):
            end()
            out.append(a)
            valued = not valued and a in VALUED
        else:
            run.append(a)
    end()
    return out


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        self.print_usage(sys.stderr)
        self.exit(1, f"{self.prog}: {message}\n")


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="siltwork", description="Reduce a noisy log to a short file.")
    p.add_argument("input", nargs="?", help="log file; standard input if omitted")
    p.add_argument("-o", "--out", help="output file; standard output if omitted")
    p.add_argument("-b", "--budget", type=int, default=8000, help="tokens to keep at most, but for one record of each kind")
    p.add_argument("--max-lines", type=int, help="records to keep at most, but for one of each kind")
    p.add_argument("-c", "--context", type=int, default=2, help="records kept around each kept one")
    p.add_argument("--no-redact", action="store_true", help="leave secrets and personal data as they are")
    p.add_argument("--format", default="auto", help="auto, json, logfmt, syslog, klog or plain")
    p.add_argument("--weights", default="0.4,0.5,0.1", help="rarity,severity,burst")
    p.add_argument("--tokenizer", help="a tokenizer's JSON file to count tokens with; else characters over four")
    p.add_argument("--stats", action="store_true", help="print figures to standard error")
    return p


def config(o: argparse.Namespace) -> ReduceConfig:
    """The options as a configuration; ValueError for those that cannot be."""
    from siltwork.functions.tokens import of_file

    more = {"tokens": of_file(o.tokenizer)} if o.tokenizer else {}
    return ReduceConfig(budget=o.budget, max_lines=o.max_lines, context=o.context, weights=weights_of(o.weights), redact=not o.no_redact, format=format_of(o.format), **more)


def session() -> SparkSession:
    spark = SparkSession.builder.appName("siltwork").config("spark.ui.showConsoleProgress", "false").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reduce_file(spark: SparkSession, o: argparse.Namespace, cfg: ReduceConfig) -> int:
    try:
        lines = logs.from_text(spark, sys.stdin.read()) if o.input is None else _file(spark, o.input)
    except (OSError, UnicodeDecodeError) as e:
        print(f"siltwork: cannot read {o.input or 'standard input'}: {e}", file=sys.stderr)
        return 2
    out = reduce_logs(lines, cfg).output()
    row = sinks.texts(out).join(sinks.stats(out), "log_id").first()  # one log, bounded by its budget and kinds
    try:
        if o.out:
            with open(o.out, "w", encoding="utf-8") as f:
                f.write(row["text"])
        else:
            print(row["text"], end="")
    except OSError as e:
        print(f"siltwork: cannot write {o.out}: {e}", file=sys.stderr)
        return 2
    if o.stats:
        print(f"[siltwork] {row['stats']}\n[siltwork] {NOTE.removeprefix('# ')}", file=sys.stderr)
    return 0


def _file(spark: SparkSession, path: str):
    if "://" not in path:
        with open(path, "rb"):
            pass  # a missing file or folder is an error of its own
        path = f"file://{os.path.abspath(path)}"
    # a name is no pattern
    return logs.from_files(spark, "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in path))


def hook(spark: Callable[[], SparkSession], text: str) -> str:
    """The answer to a prompt's hook; ``{}`` where there is no log, or anything goes wrong. Spark starts only for a prompt with a log."""
    try:
        prompt = json.loads(text).get("prompt")
        if not prompt or not isinstance(prompt, str):
            return "{}"
        import re

        for path in re.findall(f"(?m){prompts.PATH}", prompt):
            try:
                with open(path, encoding="utf-8") as f:
                    content = f.read()
            except (OSError, UnicodeDecodeError):
                continue
            if content.count("\n") + 1 >= prompts.LEAST_LINES:
                s = spark()
                files = s.createDataFrame([(path, content)], "path string, content string")
                ask = s.createDataFrame([(0, prompt)], "prompt_id int, prompt string")
                out = sinks.texts(reduce_logs(logs.from_texts(files, "path", "content")).output())
                return prompts.answers(ask, prompts.context(prompts.detect(ask, files), out)).first()["answer"]
    except Exception:  # noqa: BLE001 a hook must let every prompt pass
        pass
    return "{}"


def evaluate(spark: SparkSession, args: Sequence[str]) -> int:
    p = _Parser(prog="siltwork evaluate", description="Recall of signals over cases in folders.")
    p.add_argument("cases")
    p.add_argument("-b", "--budget", type=int, default=8000)
    p.add_argument("--split", help="one split only")
    p.add_argument("-o", "--out", help="a folder for the results as a JSON array; else a table on standard output")
    o = p.parse_args(args)
    if "://" not in o.cases and not os.path.isdir(o.cases):
        print(f"siltwork: no folder {o.cases}", file=sys.stderr)
        return 2
    c = cases.from_folders(spark, o.cases, [o.split] if o.split else list(cases.SPLITS))
    out = sinks.texts(reduce_logs(c.lines, ReduceConfig(budget=o.budget, redact=False)).output())
    report = E.case_report(c.lines, out, c.signals, c.categories).withColumn("split", F.regexp_extract("log_id", "^(.*)/[^/]*$", 1))
    if o.out:
        sinks.write_array(report, o.out, "log_id")
    else:
        report.orderBy("log_id").show(1000, truncate=False)
        E.overall(report).show(truncate=False)
    return 0


def main(args: Sequence[str]) -> int:
    if args[:1] == ["hook"]:
        print(hook(session, sys.stdin.read()), end="")
        return 0
    if args[:1] == ["evaluate"]:
        return evaluate(session(), args[1:])
    o = parser().parse_args(rejoin(args))
    if o.input == "-":
        o.input = None
    try:
        cfg = config(o)
    except (ValueError, OSError) as e:
        print(f"siltwork: {e}", file=sys.stderr)
        return 1
    return reduce_file(session(), o, cfg)
