"""Detection over units: what is found, where, and what is not."""

import json
import random
import string

import pytest
from pyspark.sql import functions as F

from credsieve.operators import after, judges
from credsieve.operators.scanner import Scanner
from credsieve.plans import catalog, config
from credsieve.plans.engine import Engine
from credsieve.operators.screen import RUN, Screen, sure_run
from credsieve.plans.scan import findings, gated
from credsieve.sources import inputs


def scanned(path, text, **options):
    return [(f.rule_id, f.secret, f.line, f.column) for f in Scanner(config.Config(**options)).scan(path, text)]


def drawn(n, alphabet=string.ascii_letters + string.digits, seed=3):
    return "".join(random.Random(seed).choices(alphabet, k=n))


HEX = "0123456789abcdef"
POSITIVE = [  # path, text, rule, value
    ("a.conf", 'password = "tr0ub4dor"', catalog.PASSWORD, "tr0ub4dor"),
    ("a.conf", "db_password: s3cr3tish", catalog.PASSWORD, "s3cr3tish"),
    ("app.py", 'client_secret = "zebra-42-quux"', catalog.SECRET, "zebra-42-quux"),
    ("a.php", "define('DB_PASSWORD', 'p@ss w0rd1');", catalog.PASSWORD, "p@ss w0rd1"),
    ("a.json", '{"apiKey": "quux9zz8yy7"}', catalog.SECRET, "quux9zz8yy7"),
    ("a.xml", "<Pass>hunter2hunter</Pass>", catalog.PASSWORD, "hunter2hunter"),
    (".netrc", "machine h login bob password qwertz99", catalog.PASSWORD, "qwertz99"),
    ("a.txt", "amqp://bob:s3cr3tP4ss@broker.internal:5672/x", catalog.URL, "s3cr3tP4ss"),
    ("a.js", 'login("bob", "tr0ub4dor")', catalog.PASSWORD, "tr0ub4dor"),
    ("a.py", 'if password == "swordfish7":', catalog.PASSWORD, "swordfish7"),
    ("a.yml", "password: |\n  first9line\n  second\nnext: 1", catalog.PASSWORD, "first9line\nsecond"),
    ("a.sh", "PASSWORD = \\\n    value9value", catalog.PASSWORD, "value9value"),
    ("a.xml", "<Password>\n   inner9value\n</Password>", catalog.PASSWORD, "inner9value"),
    ("x/.pgpass", "db.internal:5432:app:bob:zz9plural", catalog.RECORD, "db.internal:5432:app:bob:zz9plural"),
]
NEGATIVE = [
    ("app.py", "password = get_password()"), ("app.py", "token: str = None"), ("a.conf", "password = ${DB_PASSWORD}"), ("a.conf", "password = changeme"), ("a.conf", "token_type = bearer9bearer"),
    ("notes.md", "pass through a small round hole"), ("a.conf", "password = ********"), ("lexer.py", 'if token == "identifier9":'), ("a.py", 'x = ["password", "secret9value"]'), ("a.conf", "password_file = /run/x"),
    ("a.conf", 'password = "tr0ub4dor"  # gitleaks:allow'), ("a.conf", "cache_key = user:profile:42"), ("a.conf", "--- PASS: TestSomething"),
]


@pytest.mark.parametrize(("path", "text", "rule", "value"), POSITIVE)
def test_found(path, text, rule, value):
    assert (rule, value) in [(r, s) for r, s, _, _ in scanned(path, text)]


@pytest.mark.parametrize(("path", "text"), NEGATIVE)
def test_not_found(path, text):
    assert scanned(path, text) == []


def test_columns_are_of_bytes_and_values_may_start_on_the_next_line():
    assert scanned("a.conf", 'é password = "tr0ub4dor"') == [(catalog.PASSWORD, "tr0ub4dor", 1, 16)]
    assert [x[2:] for x in scanned("a.yml", "x:\n  password: |\n    first9line\n")] == [(3, 5)]


def test_earlier_stages_close_spans_to_later_ones():
    key = "ghp_" + drawn(36)
    assert [r for r, *_ in scanned("a.conf", f'github_token = "{key}"')] == ["github-pat"]
    # A pattern that is refused claims nothing.
    assert scanned("a.conf", "key = ghp_" + "a" * 36) == []


def test_encoded_text_is_scanned():
    import base64

    hidden = base64.b64encode(b'password = "SuperS3cret!"').decode()
    found = Scanner().scan("a.conf", f"data: {hidden}")
    assert [(f.rule_id, f.secret, f.line, "decoded:base64" in f.tags) for f in found] == [(catalog.PASSWORD, "SuperS3cret!", 1, True)]
    none = Scanner(config.Config(scan=config.ScanOptions(max_decode_depth=0))).scan("a.conf", f"data: {hidden}")
    assert all(f.secret != "SuperS3cret!" for f in none)


def test_related_fields_are_the_nearest():
    found = Scanner().scan("a.conf", 'user = bob\nx\npassword = "tr0ub4dor"\nhost = h1')
    assert found[0].related == "host=h1 (line 4); user=bob (line 1)"


def test_every_finding_passes_the_screen(spark):
    units = [(str(k), p, t, None) for k, (p, t, _, _) in enumerate(POSITIVE)]
    units += [("k", "a.conf", f"value {drawn(40, HEX)}", None), ("p", "a.py", "plain words of a text, and no more", None), ("n", "a.py", None, None)]
    df = spark.createDataFrame(units, "unit_id string, path string, text string, numbers array<int>")
    texts = [(u, p, t.encode()) for u, p, t, _ in units if t]
    passed = {texts[k][0] for k, _ in Screen(config.Config()).rows([x[1] for x in texts], [x[2] for x in texts])}
    expected = {u for u, p, t, _ in units if t and Scanner().scan(p, t)}
    assert expected <= passed and "p" not in passed
    found = {(r["unit_id"], r["rule_id"], r["secret"]) for r in findings(df).collect()}
    assert found == {(u, f.rule_id, f.secret.encode("latin-1").decode()) for u, p, t, _ in units if t for f in Scanner().scan(p, t)}


def test_engine_end_to_end(spark, tmp_path):
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf/app.conf").write_text('password = "tr0ub4dor"\ntoken = "%s"\n' % drawn(40, HEX))
    (tmp_path / "conf/bin.conf").write_bytes(b'\0password = "tr0ub4dor"')
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.conf").write_text('password = "tr0ub4dor"')
    engine = Engine(spark)
    result = engine.scan_path(str(tmp_path))
    assert {(r["file"], r["rule_id"], r["suppressed"]) for r in result.all().collect()} == {("conf/app.conf", catalog.PASSWORD, False), ("conf/app.conf", catalog.SECRET, True)}
    assert result.exit_code() == 1 and result.exit_code("high") == 0
    said = json.loads(result.report("json"))
    assert said["summary"]["total"] == 1 and said["summary"]["suppressed"] == 1 and "tr0ub4dor" not in json.dumps(said)
    sarif = json.loads(result.report("sarif", with_suppressed=True))["runs"][0]
    assert len(sarif["results"]) == 2 and sum("suppressions" in r for r in sarif["results"]) == 1
    assert 'failures="1"' in result.report("junit") and len(json.loads(result.report("gitlab"))["vulnerabilities"]) == 1
    assert "tr****" in result.report("text")
    path = str(tmp_path / "baseline.json")
    units = inputs.file_units(spark, str(tmp_path / "conf"))
    engine.create_baseline(units, path)
    again = engine.scan(units, baseline=inputs.read_baseline(spark, path))
    assert again.kept.isEmpty() and again.suppressed.count() == 2 and again.exit_code() == 0
    assert "no-secrets-detected" in again.report("junit")
    assert inputs.read_baseline(spark, str(tmp_path / "none.json")).isEmpty()


def test_gate_of_files(spark):
    rows = [("a.conf", 3, bytearray(b"abc")), ("a.png", 3, bytearray(b"abc")), ("b.conf", 3, bytearray(b"a\0c")), ("c.conf", 1 << 21, bytearray(b"abc"))]
    df = spark.createDataFrame(rows, "path string, length long, content binary")
    assert [r["path"] for r in gated(df, config.Config()).collect()] == ["a.conf"]


def test_collapsing(spark):
    def rows(file, lines, armor=False):
        text = "-----BEGIN PGP PUBLIC KEY BLOCK-----" if armor else "x"
        return [(file, "generic-high-entropy", k, k, text, "") for k in lines]

    data = rows("a/k.pem", range(1, 20)) + rows(".env", [1, 2, 3]) + rows("b.pem", [1, 2]) + rows("c.go", [5, 6, 7], True) + rows("d.pem", [1, 2, 3, 9, 10, 11])
    df = spark.createDataFrame(data, "file string, rule_id string, line int, ord int, line_text string, context string").withColumn("occurrences", F.lit(1))
    found = sorted((r["file"], r["line"], r["occurrences"]) for r in after.collapsed(df).collect())
    assert found == [(".env", 1, 1), (".env", 2, 1), (".env", 3, 1), ("a/k.pem", 1, 19), ("b.pem", 1, 1), ("b.pem", 2, 1), ("c.go", 5, 3), ("d.pem", 1, 3), ("d.pem", 9, 3)]


def test_offline_verdicts(spark):
    cases = [  # rule, value, entropy, file, line text -> status, confidence
        ("generic-x", "", 0.9, "a.conf", "x", "uncertain", 0.3), ("aws-access-key-id", "AKIA" + "Q7" * 8, 0.9, "a.conf", "x", "secret", 0.95), ("aws-access-key-id", "AKIAEXAMPLE", 0.9, "a", "x", "false_positive", 0.9),
        ("generic-x", "postgres", 0.4, "a", "x", "false_positive", 0.85), ("generic-x", drawn(40, HEX), 0.9, "a", "x", "false_positive", 0.7), ("generic-x", "Zq9pLm2x", 0.9, "tests/a", "x", "false_positive", 0.75),
        ("generic-x", "Zq9pLm2x", 0.9, "latest/a", "v", "uncertain", 0.5), ("generic-x", "Zq9pLm2x", 0.3, "a", "v", "uncertain", 0.4), ("vendor", "zq9", 0.3, "tests/a", "v", "secret", 0.7), ("vendor", "zq9", 0.9, "a", "v", "secret", 0.9),
        ("generic-x", "Zq9pLm2x", 0.9, "a", "# Zq9pLm2x", "false_positive", 0.85), ("generic-x", "user.password", 0.9, "a", "x = user.password", "false_positive", 0.85), ("generic-x", "123456789012345", 0.9, "a", "x", "false_positive", 0.85),
        ("postgres-uri", "postgres://foo:bar@h/x", 0.9, "a", "x", "false_positive", 0.85), ("generic-x", "a1#{b}", 0.9, "a", "x", "false_positive", 0.85), ("generic-x", "--flag", 0.9, "a", "x", "false_positive", 0.85),
    ]
    df = spark.createDataFrame([(k, *c[:4], 7, f"7: {c[4]}", c[5], c[6]) for k, c in enumerate(cases)], "k int, rule_id string, secret string, entropy double, file string, line int, context string, status string, confidence double")
    for r in judges.offline(df).collect():
        assert (r["verdict"]["status"], r["verdict"]["confidence"]) == (r["status"], r["confidence"]), cases[r["k"]]


def test_judges_in_batches(spark, tmp_path):
    text = "\n".join(f'password = "{drawn(12, seed=k)}"' for k in range(20))
    units = inputs.text_units(spark, text, "a.conf")
    sizes = str(tmp_path / "sizes")

    def judge(batch):
        with open(sizes, "a") as out:
            out.write(f"{len(batch)}\n")
        return [{"index": x["index"], "status": "secret" if x["line"] % 2 else "False Positive", "confidence": 3} for x in batch]

    result = Engine(spark, judge=judge).scan(units)
    rows = result.all().collect()
    assert len(rows) == 20 and all(r["verdict"]["status"] == ("secret" if r["line"] % 2 else "false_positive") and r["verdict"]["confidence"] == 1.0 for r in rows)
    assert max(map(int, open(sizes).read().split())) <= 8
    path = str(tmp_path / "ledger.json")
    judges.write_ledger(result.all(), path, "m:1")
    assert all(r["secret"] not in open(path).read() for r in rows)
    ledger = inputs.read_ledger(spark, path, "m:1")
    assert ledger.count() == 20 and inputs.read_ledger(spark, path, "other").isEmpty()

    def never(batch):
        raise RuntimeError("asked again")

    assert {r["verdict"]["reason"] for r in Engine(spark, judge=never).scan(units, ledger=ledger).all().collect()} == {"remembered"}
    failed = Engine(spark, judge=never).scan(units).all().collect()
    assert {r["verdict"]["status"] for r in failed} == {"uncertain"}


def test_answers_are_repaired():
    text = 'Sure:\n```json\n{"results": [{"index": 0, "status": "secret", "confidence": 0.9}]}\n```\n{"index": 1, "status": "uncertain"} [{"index": 1, "status": "secret"}, {"index": 9}]'
    found = judges.mapped(judges.results_in(text), 3, "j")
    assert [x[0] for x in found] == ["secret", "uncertain", "uncertain"] and found[2][2] == "no verdict"
    calls = []

    def picky(batch):
        calls.append(len(batch))
        if len(batch) > 1:
            raise ValueError("too many")
        return [{"index": 0, "status": "secret"}]

    assert sorted(x["index"] for x in judges.halving(picky)([{"index": k} for k in range(4)])) == [0, 1, 2, 3]


def test_provider_keys_under_test_paths_stay(spark):
    key = "AKIA" + drawn(16, string.ascii_uppercase + string.digits)
    wrong = lambda batch: [{"index": x["index"], "status": "false_positive", "confidence": 0.9} for x in batch]
    rows = Engine(spark, judge=wrong).scan(inputs.text_units(spark, f"aws = {key}", "tests/a.conf")).all().collect()
    assert [(r["rule_id"], r["suppressed"], r["verdict"]["status"]) for r in rows] == [("aws-access-key-id", False, "uncertain")]


def test_options():
    made = config.from_toml('[entropy]\nmin_length = 3\n[scan]\nmax_decode_depth = 9\nignore_paths = ["x"]\n[[rules.custom]]\nid = "own"\nregex = "own-[0-9]{6}"\nseverity = "high"\n')
    assert (made.entropy.min_length, made.scan.max_decode_depth, made.scan.ignore_paths) == (16, 5, ["x"])
    assert [x[0] for x in [(f.rule_id,) for f in Scanner(made).scan("a", "see own-918273")]] == ["own"]
    for bad in ("[scan]\nnope = 1", "[report]\nformat = 'pdf'", "[nope]\nx = 1"):
        with pytest.raises(ValueError):
            config.from_toml(bad)
    with pytest.raises(ValueError):
        config.from_toml('[ai]\ncommand = ["x"]', discovered=True)


def test_allow_lists():
    text = 'password = "tr0ub4dor"'
    name = Scanner().scan("a.conf", text)[0].fingerprint
    for options in ({"fingerprints": [name]}, {"regexes": ["^tr0ub"]}, {"stopwords": ["ub4d"]}):
        assert scanned("a.conf", text, allowlist=config.AllowOptions(**options)) == []
    assert scanned("a.conf", text, rules=config.RuleOptions(disable=[catalog.PASSWORD])) == []


def test_tool_frames(spark):
    engine = Engine(spark)
    call = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "scan_text", "arguments": {"content": 'password = "tr0ub4dor"'}}}
    said = json.loads(engine.answer(json.dumps(call)))
    assert said["result"][0]["rule_id"] == catalog.PASSWORD and "tr0ub4dor" not in json.dumps(said)
    assert "error" in json.loads(engine.answer("{")) and "error" in json.loads(engine.answer('{"id": 2, "method": "x"}'))
    assert engine.answer('{"method": "notify"}') is None
    assert engine.verify("AKIA" + "Q7" * 8, rule_id="aws-access-key-id")["status"] == "secret"


def test_decisions(spark):
    rows = [
        {"tool_name": "Write", "cwd": "/w", "tool_input": {"file_path": "/w/a.conf", "content": 'password = "tr0ub4dor"'}},
        {"tool_name": "MultiEdit", "cwd": "/w", "tool_input": {"file_path": "/w/b.conf", "edits": [{"new_string": "x"}, {"new_string": 'password = "tr0ub4dor"'}]}},
        {"tool_name": "Write", "cwd": "/w", "tool_input": {"file_path": "/w/c.conf", "content": "nothing"}}, {"tool_name": "Write", "cwd": "/w", "tool_input": {"file_path": "/w/.credsieve.toml", "content": 'password = "tr0ub4dor"'}},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("not json",)], "payload string")
    found = Engine(spark).decide(df).collect()
    assert len(found) == 2 and {r["decision"] for r in found} == {"deny"} and all("tr0ub4dor" not in r["reason"] for r in found)


def test_commands_that_commit(spark):
    table = {"git commit -m x": True, "cd a && git -C b add .": True, "git log": False, "echo git commit": False, "git --no-pager stage x; ls": True, "mygit commit": False}
    df = spark.createDataFrame([(k,) for k in table], "c string")
    assert {r[0]: r[1] for r in df.select("c", inputs.commits_something(F.col("c"))).collect()} == table


def test_custom_rules_with_anchors_match_lines(spark):
    own = config.from_toml("[[rules.custom]]\nid = 'own'\nregex = '^API=([0-9]{8})$'\nsecret_group = 1\n")
    texts = ["a\nAPI=13572468\nb", "a\r\nAPI=13572468\r\nb\r\n", "API=13572468", "x\nAPI=13572468", "x API=13572468", "API=135724689\nx"]
    units = spark.createDataFrame([(str(k), "a.txt", x, None) for k, x in enumerate(texts)], "unit_id string, path string, text string, numbers array<int>")
    exact = {str(k) for k, x in enumerate(texts) if any(f.rule_id == "own" for f in Scanner(own).scan("a.txt", x))}
    assert exact == {"0", "1", "2", "3"}
    assert {r["unit_id"] for r in findings(units, own).where("rule_id = 'own'").collect()} == exact


def test_sure_runs_follow_from_patterns():
    table = {r"\b(gh[po]_[A-Za-z0-9]{36})\b": 40, r"[a-z]+x{3}": 4, r"(?:ab|[0-9]{4})c": 3, r"a.b{20}": 20, r"(?i)key\s*=\s*([A-Z]{8,})": 8, r"(ab){3,}": 6, r"(?:a|b-c)?d": 1, r"[^x]{30}": 0, r"(?:x\.){20}y{2}": 2}
    assert {p: sure_run(p) for p in table} == table
    assert all(sure_run(r.pattern) >= RUN or r.keywords for r in catalog.builtin())


def test_screen_over_joined_texts():
    """Runs don't reach over the ends of texts, and lines are counted within each text."""
    screen = Screen(config.Config())
    texts = [b"a" * 12, b"b" * 12 + b"\n\nx\npassword = 1", b"", b"\n" + b"7" * 16, b"plain", b"q" * 15 + b"\n" + b"q" * 3]
    assert list(screen.rows(["a.txt"] * 6, texts)) == [(1, [3]), (3, [1])]
    assert list(screen.rows(["a.txt", "x/passwords.txt"], [b"", b"plain\nwords"])) == [(1, None)]
    own = config.from_toml("[[rules.custom]]\nid = 'own'\nregex = '[xyz]{4}!'\n")
    assert list(Screen(own).rows(["a.txt"], [b"plain"])) == [(0, None)]
