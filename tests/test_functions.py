"""Native expressions and the exact scanner say the same, and both say what is known."""

import random

import pytest
from pyspark.sql import functions as F

from credsieve.functions import keys, paths, secrets, text
from credsieve.operators import scanner
from credsieve.plans import catalog
from credsieve.plans import values as V


def values(n=250):
    rng = random.Random(1)
    alphabets = ["abcdefghij", "ABCDEF0123456789", "aZ09+/=", "é ñ ü", "p@$$ w0rd", "0123456789", "the quick brown", "_-.:/x9A"]
    made = ["".join(rng.choice(a) for _ in range(rng.randint(1, 40))) for a in alphabets for _ in range(n // len(alphabets))]
    return [*made, "", "a", "aaaaa", "abcdefg", "gfedcba", "changeme", "example42", "swordfish", "KeySize768", "user:profile:42", "${X}", "%s", "p%40ss", "<b>", "/etc/x"]


def by_value(spark, **columns):
    df = spark.createDataFrame([(v,) for v in values()], "v string")
    return {r["v"]: r for r in df.select("v", *(c.alias(k) for k, c in columns.items())).collect()}


def test_both_lanes_agree_on_values(spark):
    v = F.col("v")
    found = by_value(
        spark, e2=text.renyi_entropy(v), e1=text.renyi_entropy(v, 1.0), e05=text.renyi_entropy(v, 0.5), charset=text.charset_class(v), score=text.normalized_score(v),
        placeholder=text.is_placeholder(v), literal=keys.is_literal(v, F.lit(True)), bare=keys.is_literal(v, F.lit(False)), shaped=text.secret_shaped(v), symbol=keys.identifier_like(v),
        b64=secrets.decode_base64(v), hexed=secrets.decode_hex(v), words=keys.key_words(v), kind=keys.classify_key(v),
    )
    tool = scanner.Scanner()
    for value, r in found.items():
        held = scanner.to_bytes_text(value)
        for alpha, name in ((2.0, "e2"), (1.0, "e1"), (0.5, "e05")):
            assert r[name] == pytest.approx(scanner.renyi(held, alpha), abs=1e-9)
        assert r["score"] == pytest.approx(scanner.score(held), abs=1e-9)
        assert r["placeholder"] == scanner.is_placeholder(held, V.STOPWORDS), value
        if value:
            assert r["charset"] == scanner.charset(held), value
            assert r["literal"] == tool._is_literal(held, True), value
            assert r["bare"] == tool._is_literal(held, False), value
            assert r["shaped"] == scanner._secret_shaped(held), value
            assert r["symbol"] == scanner._identifier_like(held), value
        assert r["words"] == scanner.key_words(value), value
        assert r["kind"] == scanner.key_class(value), value
        assert r["hexed"] == scanner.from_hex(held), value


def test_known_entropies(spark):
    df = spark.createDataFrame([("aab",)], "v string")
    r = df.select(text.renyi_entropy(F.col("v"), 1.0).alias("a"), text.renyi_entropy(F.col("v")).alias("b"), text.renyi_entropy(F.col("v"), 0.5).alias("c"), text.expected_collision(F.lit(32), F.lit(16)).alias("d")).first()
    assert [round(x, 4) for x in r] == [0.9183, 0.8480, 0.9581, 3.4454]


def test_random_values_score_above_words():
    import hashlib
    import secrets as random_source

    drawn = [random_source.token_urlsafe(30) for _ in range(20)] + [hashlib.sha256(bytes([k])).hexdigest() for k in range(20)]
    human = ["aaaaaaaaaabbbbbbbbbb", "thisisthisisthisisthis", "localhost-localhost-localhost", "passwordpassword"]
    assert min(map(scanner.score, drawn)) >= 0.85 and max(map(scanner.score, human)) < min(map(scanner.score, drawn))


@pytest.mark.parametrize(
    ("key", "words"),
    [("AdminPassword", ["admin", "password"]), ("IRC_PASS", ["irc", "pass"]), ("APIKey", ["api", "key"]), ("db.password", ["db", "password"]), ("", []), ("x-y", ["x", "y"])],
)
def test_key_words(key, words):
    assert scanner.key_words(key) == words


def test_paths(spark):
    known = {  # test tree, key material, needs quotes, credential file
        "src/app.py": (False, False, True, False), "latest/x.conf": (False, False, False, False), "dockerTest/a.yml": (True, False, False, False),
        "a/tests/b.env": (True, False, False, False), "x/id_rsa": (False, True, False, False), "k/server.pem": (False, True, False, False),
        ".pgpass": (False, False, False, True), "secrets.yml": (False, False, False, True), "password_reset.rb": (False, False, True, False), "README": (False, False, True, False),
    }
    p = F.col("p")
    df = spark.createDataFrame([(k,) for k in known], "p string")
    for r in df.select("p", paths.is_test_path(p), paths.is_key_material(p), paths.needs_quotes(p), paths.is_credential_file(p)).collect():
        assert tuple(r)[1:] == known[r[0]], r[0]
        assert scanner.needs_quotes(r[0]) == r[3] and scanner.is_credential_file(r[0]) == r[4]


def test_globs(spark):
    table = [
        ("*.min.js", "a/b/x.min.js", True), ("*.min.js", "x.js", False), ("vendor/**", "vendor/a.go", True), ("vendor/**", "pkg/vendor/a/b.go", True), ("vendor/**", "myvendor/a.go", False),
        ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("go.sum", "x/go.sum", True), ("?.txt", "ab.txt", False), ("a?c", "abc", True), ("*.lock", "x\nlock", False), (".git/**", ".git/x", True),
    ]
    for glob, path, expected in table:
        df = spark.createDataFrame([(path,)], "p string")
        assert df.select(paths.matches_globs(F.col("p"), [glob])).first()[0] == expected, (glob, path)


def test_masks(spark):
    df = spark.createDataFrame([("",), ("short",), ("tenletters",), ("sixteen-letters!",)], "v string")
    assert [r[0] for r in df.select(secrets.redact(F.col("v"))).collect()] == ["", "****", "te****", "sixt****ers!"]


def test_decoding(spark):
    import base64

    plain = "user=bob pass=hunter2 é"
    cases = [base64.b64encode(plain.encode()).decode(), base64.urlsafe_b64encode(plain.encode()).decode().rstrip("="), base64.b64encode(bytes(range(30))).decode(), "!!!!"]
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    assert [r[0] for r in df.select(secrets.decode_base64(F.col("v"))).collect()] == [plain, plain, None, None]
    df = spark.createDataFrame([("a%20b%3Dcdef+",), ("100% of 50% x",), ("plain",), ("caf\\u00e9 \\u0041bc",)], "v string")
    assert [r[0] for r in df.select(secrets.decode_percent(F.col("v"))).collect()] == ["a b=cdef+", None, None, None]
    assert [r[0] for r in df.select(secrets.decode_unicode_escapes(F.col("v"))).collect()] == [None, None, None, "café Abc"]


def test_catalog_invariants():
    rules = catalog.builtin()
    assert len(rules) >= 50 and len({r.id for r in rules}) == len(rules)
    for r in rules:
        assert r.id == r.id.lower() and " " not in r.id and r.severity in catalog.RANKS
        assert all(k == k.lower() for k in r.keywords) and 0 <= (r.floor or 0) <= 1
        assert r.group <= scanner._re(r.pattern).groups


def test_patterns_for_the_jvm(spark):
    df = spark.createDataFrame([("éghp_" + "a1B2" * 9,), ("xghp_" + "a1B2" * 9,), ("a\u2028b",)], "v string")
    github = next(r for r in catalog.builtin() if r.id == "github-pat")
    assert [r[0] for r in df.select(text.matches(F.col("v"), github.pattern)).collect()] == [True, False, False]
    assert df.select(text.matches(F.col("v"), "^a.b$")).collect()[2][0]
