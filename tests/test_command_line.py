"""The command line, the session, the hook's answers, SQL functions and stored results."""

import io
import json

import pytest

from credsieve.__main__ import decided, main
from credsieve.functions import sql
from credsieve.plans import catalog, config
from credsieve.plans.engine import FRAME_BYTES, Engine
from credsieve.sources import inputs

LEAK = 'password = "tr0ub4dor"'


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf/app.conf").write_text(LEAK + "\n")
    (tmp_path / "conf/clean.txt").write_text("nothing here\n")
    return tmp_path


def test_scan_and_exit_codes(spark, tree, capsys):
    assert main(["scan", str(tree / "conf"), "--format", "json"], spark) == 1
    said = json.loads(capsys.readouterr().out)
    assert said["files_scanned"] == 2 and said["summary"]["total"] == 1 and "tr0ub4dor" not in json.dumps(said)
    assert main(["scan", str(tree / "conf"), "--fail-on", "critical", "--output", str(tree / "out.txt")], spark) == 0
    assert "tr****" in (tree / "out.txt").read_text()
    assert main(["scan", str(tree / "conf"), "--config", str(tree / "missing.toml")], spark) == 2
    assert main(["scan"], spark) == 2 and main(["version"], spark) == 0


def test_baseline_suppresses(spark, tree, capsys):
    path = str(tree / "accepted.json")
    assert main(["baseline", "create", str(tree / "conf"), "--baseline", path], spark) == 0
    assert main(["scan", str(tree / "conf"), "--baseline", path, "--format", "json", "--show-suppressed"], spark) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["summary"] | {"by_severity": 0, "by_verdict": 0} == {"total": 0, "files": 0, "suppressed": 1, "by_severity": 0, "by_verdict": 0}
    assert said["suppressed"][0]["verdict"]["verifier"] == "baseline"


def test_a_judge_is_asked_once_and_never_about_known_findings(spark, tree):
    asked = spark.sparkContext.accumulator(0)

    def judge(batch):
        asked.add(len(batch))
        return [{"index": x["index"], "status": "secret", "confidence": 0.9, "reason": "it is"} for x in batch]

    units = inputs.text_units(spark, LEAK + "\nb_password = 'wh4tever9z'\n", "a.conf")
    engine = Engine(spark, judge=judge)
    one = engine.scan(units)
    assert {r["verdict"]["status"] for r in one.all().collect()} == {"secret"} and one.exit_code() == 1 and one.report("json")
    assert asked.value == 2
    known = one.all().limit(1).select("fingerprint")
    two = engine.scan(units, baseline=known)
    assert sorted((r["suppressed"], r["verdict"]["verifier"]) for r in two.all().collect()) == [(False, "judge"), (True, "baseline")] and asked.value == 3


def test_the_corpus_is_read_once_with_a_baseline(spark, tree):
    units = inputs.file_units(spark, str(tree / "conf"))
    rows = Engine(spark).scan(units, baseline=spark.createDataFrame([("x",)], "fingerprint string")).rows
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_session(spark):
    engine = Engine(spark)
    frames = [
        json.dumps({"id": 1, "method": "initialize"}), "x" * (FRAME_BYTES + 1), "{", "[1]", "", json.dumps({"method": "notifications/initialized"}),
        json.dumps({"id": 2, "method": "tools/call", "params": {"name": "scan_text", "arguments": {}}}), json.dumps({"id": 3, "method": "tools/list"}),
        json.dumps({"id": 4, "method": "tools/call", "params": {"name": "scan_text", "arguments": {"content": LEAK}}}), json.dumps({"id": 5, "method": "nothing"}),
    ]
    said = [json.loads(x) for x in engine.session(frames)]
    assert [x.get("error", {}).get("code") for x in said] == [None, -32600, -32700, -32600, -32602, None, None, -32601]
    assert said[0]["result"]["serverInfo"]["name"] == "credsieve" and len(said[5]["result"]["tools"]) == 3
    assert said[6]["result"][0]["rule_id"] == catalog.PASSWORD


def test_hook_answers(spark, capsys, monkeypatch):
    payload = json.dumps({"hook_event_name": "PreToolUse", "tool_name": "Write", "cwd": "/w", "tool_input": {"file_path": "/w/a.conf", "content": LEAK}})
    said = json.loads(decided(Engine(spark), payload))["hookSpecificOutput"]
    assert said["permissionDecision"] == "deny" and "tr0ub4dor" not in json.dumps(said)
    asking = config.Config(hook=config.HookOptions(decision="ask", fail_open=False))
    assert json.loads(decided(Engine(spark, asking), payload))["hookSpecificOutput"]["permissionDecision"] == "ask"
    assert decided(Engine(spark), "not json") == "" and json.loads(decided(Engine(spark, asking), "not json"))["hookSpecificOutput"]["permissionDecision"] == "deny"
    monkeypatch.setattr("sys.stdin", io.StringIO(payload.replace("tr0ub4dor", "")))
    assert main(["hook"], spark) == 0 and capsys.readouterr().out == ""


def test_sql_functions(spark):
    assert sql.register(spark) == ["cs_entropy", "cs_charset", "cs_is_placeholder", "cs_scan"]
    spark.createDataFrame([("a.conf", LEAK), ("a.conf", None)], "path string, text string").createOrReplaceTempView("given")
    rows = spark.sql("SELECT cs_entropy(text) AS e, cs_charset(text) AS c, cs_scan(path, text) AS f FROM given ORDER BY text NULLS LAST").collect()
    assert rows[0]["c"] == "printable" and 0 < rows[0]["e"] <= 1.25 and rows[0]["f"][0]["rule_id"] == catalog.PASSWORD
    assert tuple(rows[1]) == (None, None, None)
    assert spark.sql("SELECT cs_is_placeholder('changeme12')").first()[0]


def test_judge_options_of_an_address_are_known():
    made = config.from_toml("[ai]\nmodel = 'm'\nbase_url = 'http://localhost'\napi_key_env = 'KEY'\nreasoning_effort = 'low'\n")
    assert (made.ai.model, made.ai.api_key_env) == ("m", "KEY")
