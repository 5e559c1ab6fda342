"""Evaluation, prompts, sinks and options on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from siltwork.config import ReduceConfig, format_of, weights_of
from siltwork.operators import evaluate as E
from siltwork.operators.reduce import reduce_logs
from siltwork.sources import logs, prompts, sinks


def lines_of(spark, text, name="a"):
    return logs.from_texts(spark.createDataFrame([(name, text)], "id string, text string"), "id", "text")


def test_fingerprints(spark):
    rows = ["\x1b[31m2024-01-01T00:00:00.12Z  broken \t pipe here\x1b[0m ", "short", "", None]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", E.fingerprint(F.col("x")).alias("f"))
    assert [r.f for r in d.orderBy("i").collect()] == ["broken pipe here", None, None, None]


def test_recall_clips_spans_and_is_one_without_signals(spark):
    lines = lines_of(spark, "first line of log\nERROR disk is full\nlast line of log").unionByName(lines_of(spark, "nothing of note", "b"))
    outputs = spark.createDataFrame([("a", "# head\n\nERROR  disk is full\n… 2 lines omitted …\n"), ("b", "")], "log_id string, text string")
    signals = spark.createDataFrame([("a", 1, "critical", [[0, 2]]), ("a", 2, "critical", [[3, 2_000_000_000]]), ("a", 3, "important", [[9, 1]])], "log_id string, signal int, importance string, evidence_lines array<array<int>>")
    a, b = E.case_report(lines, outputs, signals).orderBy("log_id").collect()
    assert (a.critical_recall, a.critical_hits, a.critical_total, a.important_recall, a.kept_lines) == (0.5, 1, 2, 0.0, 2)
    assert (b.critical_recall, b.critical_total, b.kept_lines, b.failure_category) == (1.0, 0, 0, "?")


def test_tail_truncation_keeps_headers_and_the_end(spark):
    rows = spark.createDataFrame([("a", i, "# head" if i == 0 else f"line {i}") for i in range(10)] + [("b", 0, "fits")], "log_id string, ord long, text string")
    got = [r.text for r in E.tail_truncate(rows, 30).where("log_id = 'a'").orderBy("ord").collect()]
    assert got == ["# head", "… 6 lines truncated (context too large for LLM) …", "line 7", "line 8", "line 9"]
    assert E.tail_truncate(rows, 30).where("log_id = 'b'").count() == 1


def test_prompt_names_a_log(spark):
    long, short = "\n".join(["INFO ok", "ERROR bad thing"] * 300), "a\nb"
    files = spark.createDataFrame([("/var/x.log", long), ("./y.log", short)], "path string, content string")
    asks = [(1, json.dumps({"prompt": "see ./y.log then /var/x.log please", "id": 3})), (2, json.dumps({"prompt": "only ./y.log"})), (3, "not json"), (4, "{}")]
    p = prompts.from_json(spark.createDataFrame(asks, "prompt_id int, value string"))
    found = prompts.detect(p, files)
    outputs = sinks.texts(reduce_logs(logs.from_texts(files, "path", "content")).output())
    got = {r.prompt_id: json.loads(r.answer) for r in prompts.answers(p, prompts.context(found, outputs)).collect()}
    assert got[2] == got[3] == got[4] == {} and got[1]["hookSpecificOutput"]["hookEventName"] == "UserPromptSubmit"
    text = got[1]["hookSpecificOutput"]["additionalContext"]
    assert "/var/x.log" in text and "600 lines" in text and "ERROR bad thing" in text


def test_sinks_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.log").write_text("INFO a\r\nERROR b\n")
    r = reduce_logs(logs.from_files(spark, str(tmp_path / "in")))
    out = r.output()
    sinks.write_texts(out, str(tmp_path / "texts"))
    sinks.write_rows(r.rows, str(tmp_path / "rows"))
    assert [x.value for x in spark.read.text(str(tmp_path / "rows")).collect()] == ["INFO a", "ERROR b"]
    assert "ERROR b" in "".join(p.read_text() for p in (tmp_path / "texts").rglob("*.txt"))
    assert sinks.stats(out).first().stats.startswith("2 lines → 2 kept | tokens ")


def test_options():
    assert weights_of("0.1, 0.2,0.7") == (0.1, 0.2, 0.7) and format_of("GLOG") == "klog" and format_of("x") == "auto"
    for bad in ("1,2", "a,b,c"):
        with pytest.raises(ValueError):
            weights_of(bad)
    with pytest.raises(ValueError):
        ReduceConfig(budget=0)
    with pytest.raises(ValueError):
        ReduceConfig(weights=(float("nan"), 1, 1))
