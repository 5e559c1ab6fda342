"""The command line, evaluation cases, the hook and counters of tokens."""

import io
import json
import sys

import pytest

from siltwork import cli
from siltwork.config import ReduceConfig
from siltwork.functions.tokens import of_file
from siltwork.operators import evaluate as E
from siltwork.operators.reduce import reduce_logs
from siltwork.sources import cases, logs, sinks


@pytest.fixture(autouse=True)
def session(spark, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)


def test_paths_with_spaces_are_rejoined():
    exists = {"logs/foo 12:30.log", "a b"}.__contains__
    assert cli.rejoin(["logs/foo", "12:30.log", "--budget", "5"], exists) == ["logs/foo 12:30.log", "--budget", "5"]
    assert cli.rejoin(["--out", "a", "b", "c"], exists) == ["--out", "a", "b", "c"]
    assert cli.rejoin(["--stats", "a", "b", "-c=1"], exists) == ["--stats", "a b", "-c=1"]
    assert cli.rejoin(["no", "such", "path"], exists) == ["no", "such", "path"]


def test_reduces_a_file(tmp_path, capsys):
    log = tmp_path / "a [b] 1.log"
    log.write_text("\n".join(["INFO health ok"] * 50 + ["ERROR disk full password=hunter2222"]) + "\n")
    assert cli.main([*str(log).split(" "), "--budget", "100", "--stats"]) == 0
    out = capsys.readouterr()
    assert out.out.startswith("# LOG SUMMARY  |  51 lines → ") and "ERROR disk full" in out.out and "hunter" not in out.out and "51 lines → " in out.err
    assert cli.main([str(log), "--no-redact", "-o", str(tmp_path / "out.txt")]) == 0
    assert "hunter2222" in (tmp_path / "out.txt").read_text()


def test_reads_standard_input_and_empty_logs(tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(sys, "stdin", io.StringIO("WARN one\nINFO two\n"))
    assert cli.main([]) == 0 and "WARN one\nINFO two" in capsys.readouterr().out
    (tmp_path / "empty.log").write_text("")
    assert cli.main([str(tmp_path / "empty.log")]) == 0
    assert capsys.readouterr().out.startswith("# LOG SUMMARY  |  0 lines → 0 kept (0%)\n# levels: FATAL 0")


def test_exit_codes(tmp_path, capsys):
    assert cli.main([str(tmp_path / "none.log")]) == 2
    assert cli.main(["x.log", "--weights", "1,2"]) == 1 and cli.main(["x.log", "--budget", "0"]) == 1
    assert cli.main(["x.log", "--tokenizer", str(tmp_path / "none.json")]) == 1
    (tmp_path / "a.log").write_text("INFO a\n")
    assert cli.main([str(tmp_path / "a.log"), "--out", str(tmp_path / "no" / "such")]) == 2
    with pytest.raises(SystemExit) as e:
        cli.main(["--no-such-option"])
    assert e.value.code == 1
    assert cli.main(["evaluate", str(tmp_path / "none")]) == 2
    capsys.readouterr()


def test_hook(tmp_path, spark):
    log = tmp_path / "app.log"
    log.write_text("\n".join(["INFO ok"] * 599 + ["ERROR bad thing"]))
    (tmp_path / "short.log").write_text("a\nb\n")
    answer = json.loads(cli.hook(lambda: spark, json.dumps({"prompt": f"look at {tmp_path}/short.log or {log} please"})))
    text = answer["hookSpecificOutput"]["additionalContext"]
    assert str(log) in text and "600 lines" in text and "ERROR bad thing" in text and f"python -m siltwork {log} --context 5" in text
    for bad in ("", "[]", "{}", '{"prompt": ""}', '{"prompt": 5}', json.dumps({"prompt": f"see {tmp_path}/short.log"})):
        assert cli.hook(lambda: spark, bad) == "{}"


def test_cases_from_folders(tmp_path, spark):
    def case(name, log, truth="{}", meta=None):
        d = tmp_path / name
        d.mkdir(parents=True)
        (d / "raw.log").write_bytes(log)
        (d / "ground_truth.json").write_text(truth)
        if meta:
            (d / "case.json").write_text(meta)

    truth = json.dumps({"required_signals": [{"importance": "critical", "evidence_lines": [[2, 2]], "more": 1}, {"importance": "important", "evidence_lines": [[9, 12]]}]})
    case("dev/one", b"INFO first line here\r\nERROR the disk is full \xff\r\n", truth, '{"failure_category": "disk"}')
    case("v2/holdout/two", b"INFO nothing to see here\n")
    case("other/three", b"x\n", truth)
    (tmp_path / "dev" / "nolog").mkdir()
    (tmp_path / "dev" / "nolog" / "ground_truth.json").write_text(truth)
    c = cases.from_folders(spark, str(tmp_path))
    assert [(r.log_id, r.pos, r.line) for r in c.lines.orderBy("log_id", "pos").collect()] == [("dev/one", 0, "INFO first line here"), ("dev/one", 1, "ERROR the disk is full �"), ("v2/holdout/two", 0, "INFO nothing to see here")]
    out = sinks.texts(reduce_logs(c.lines, ReduceConfig(redact=False)).output())
    a, b = E.case_report(c.lines, out, c.signals, c.categories).orderBy("log_id").collect()
    assert (a.critical_recall, a.important_recall, a.failure_category) == (1.0, 0.0, "disk") and (b.critical_total, b.failure_category) == (0, "?")
    assert cli.main(["evaluate", str(tmp_path), "-o", str(tmp_path / "out"), "--budget", "500"]) == 0
    text = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "out").glob("part-*")))
    assert [(x["log_id"], x["split"]) for x in json.loads(text)] == [("dev/one", "dev"), ("v2/holdout/two", "v2/holdout")]


def test_array_of_no_rows(tmp_path, spark):
    sinks.write_array(spark.range(0), str(tmp_path / "x"), "id")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "x").glob("part-*"))) == []


def test_tokens_of_a_file(spark):
    public = pytest.importorskip("public_tokenizers")
    counter = of_file(public.path("byte_bpe_50k.json"))
    lines = logs.from_text(spark, "INFO a b c\nERROR internationalization")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = {r.raw: r.tokens for r in reduce_logs(lines, ReduceConfig(tokens=counter)).records.collect()}
    assert got == {x: len(tok.encode(x, add_special_tokens=False).ids) for x in got} and len(got) == 2
