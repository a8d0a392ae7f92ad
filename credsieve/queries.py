"""Queries over the driver's tables: each applies an operator to whole tables; SQL for DuckDB beside it where SQL can say it.

The tables hold few credentials, so lines are also derived from table keys by one SQL text that both engines read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credsieve.functions import keys as K
from credsieve.functions import paths as P
from credsieve.functions import secrets as S
from credsieve.functions import text as X
from credsieve.operators import after, lines, metrics, reports
from credsieve.plans import values as V
from credsieve.plans.catalog import Rule, builtin, for_jvm
from credsieve.plans.config import Config
from credsieve.plans.engine import Engine
from credsieve.plans.scan import findings, native_sweep, units_of_table
from credsieve.sources import diffs, inputs
from credsieve.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(made: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[made.__name__] = made
        if sql:
            ORACLE_SQL[made.__name__] = sql
        return made

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- derived lines: the same text for both engines -------------------------------------------------

DERIVED = """
    SELECT p_partkey AS k,
        CASE p_partkey % 7 WHEN 0 THEN 'src/app.py' WHEN 1 THEN 'config/prod.env' WHEN 2 THEN 'tests/unit/app_test.py'
            WHEN 3 THEN 'docs/guide.md' WHEN 4 THEN 'db/.pgpass' WHEN 5 THEN 'certs/client.key' ELSE 'latest/main.conf' END AS path,
        CAST(p_partkey % 40 + 1 AS INT) AS number,
        CASE p_partkey % 14
            WHEN 0 THEN concat('key = ghp_', substr(concat(md5(p_name), md5(CAST(p_partkey AS STRING))), 1, 36))
            WHEN 1 THEN concat('password = "', substr(md5(CAST(p_partkey AS STRING)), 1, 14), '"')
            WHEN 2 THEN concat('db: ', CASE WHEN p_partkey % 28 = 2 THEN 'amqp' ELSE 'postgres' END, '://svc:', substr(md5(CAST(p_partkey AS STRING)), 1, 16), '@db', CAST(p_partkey AS STRING), '.internal:5432/app')
            WHEN 3 THEN concat('id: ', substr(md5(p_name), 1, 8), '-', substr(md5(p_name), 9, 4), '-', substr(md5(p_name), 13, 4), '-', substr(md5(p_name), 17, 4), '-', substr(md5(p_name), 21, 12))
            WHEN 4 THEN concat('commit ', substr(concat(md5(CAST(p_partkey AS STRING)), md5(p_name)), 1, 40))
            WHEN 5 THEN concat('value ', substr(concat(md5(CAST(p_partkey AS STRING)), md5(p_name)), 1, 40))
            WHEN 6 THEN concat('api_key: changeme', CAST(p_partkey AS STRING))
            WHEN 7 THEN concat('the quick brown fox ', CAST(p_partkey AS STRING), ' jumps over')
            WHEN 8 THEN concat('aws = AKIA', upper(substr(md5(CAST(p_partkey AS STRING)), 1, 16)))
            WHEN 9 THEN concat('auth token ', translate(concat(md5(CAST(p_partkey AS STRING)), substr(md5(p_name), 1, 8)), '0123456789abcdef', 'qW3rT7uIoP9sDfGh'))
            WHEN 10 THEN concat('<Password>', substr(md5(CAST(p_partkey AS STRING)), 1, 12), '</Password>')
            WHEN 11 THEN concat('login("svc", "', substr(md5(CAST(p_partkey AS STRING)), 1, 10), '")')
            WHEN 12 THEN concat('machine host login svc password ', substr(md5(CAST(p_partkey AS STRING)), 1, 12))
            ELSE concat('sha256 ', md5(CAST(p_partkey AS STRING)), md5(p_name)) END AS text
    FROM part"""

#: A value for each part: of ten shapes, and of its own length.
VALUES = """
    SELECT p_partkey AS k, CASE p_partkey % 10
            WHEN 0 THEN substr(md5(p_name), 1, CAST(8 + p_partkey % 24 AS INT))
            WHEN 1 THEN upper(substr(md5(p_name), 1, 20))
            WHEN 2 THEN translate(md5(p_name), '0123456789abcdef', 'qW3rT7uIoP9sDfGh')
            WHEN 3 THEN concat('example', CAST(p_partkey AS STRING))
            WHEN 4 THEN CAST(p_partkey * 7919 AS STRING)
            WHEN 5 THEN concat('aaaaa', CAST(p_partkey AS STRING))
            WHEN 6 THEN translate(md5(p_name), '0123456789abcdef', 'ghijklmnopqrstuv')
            WHEN 7 THEN concat('p@ss ', p_name)
            WHEN 8 THEN concat('abcdefg', md5(p_name))
            ELSE concat(translate(md5(p_name), '0123456789', '+/=-_ABCDE'), '7') END AS v
    FROM part"""

NAMES = """
    SELECT p_partkey AS k, CASE p_partkey % 12 WHEN 0 THEN 'AdminPassword' WHEN 1 THEN 'IRC_PASS' WHEN 2 THEN 'APIKey' WHEN 3 THEN 'db.user'
            WHEN 4 THEN 'token_type' WHEN 5 THEN 'access_key_id' WHEN 6 THEN 'PASS' WHEN 7 THEN 'publicKey' WHEN 8 THEN 'sessionKey'
            WHEN 9 THEN 'compass' WHEN 10 THEN 'client-secret' ELSE p_name END AS name
    FROM part"""

PATHS = """
    SELECT l_orderkey AS o, l_linenumber AS n, concat(
        CASE l_orderkey % 6 WHEN 0 THEN 'src/main/' WHEN 1 THEN 'latest/' WHEN 2 THEN 'integrationTest/java/' WHEN 3 THEN 'docs/'
            WHEN 4 THEN 'node_modules/pkg/' ELSE 'a/testdata/b/' END,
        CASE l_linenumber % 7 WHEN 0 THEN 'app.py' WHEN 1 THEN 'client_test.go' WHEN 2 THEN 'README' WHEN 3 THEN 'id_rsa' WHEN 4 THEN 'server.pem'
            WHEN 5 THEN 'secrets.yml' ELSE 'app.min.js' END) AS path
    FROM lineitem"""


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the texts above."""
    for name in ("part", "lineitem", "orders", "customer", "documents"):
        if f"FROM {name}" in sql:
            return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=table(spark, sf_dir, name))
    raise ValueError("no table in the text")


def derived_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, DERIVED)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.to_lines(docs.select(F.col("doc_id").alias("unit_id"), "text"))


# ---- pieces of DuckDB SQL ---------------------------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def sql_in(column: str, words: tuple[str, ...]) -> str:
    return f"({column} IN ({', '.join(map(q, words))}))"


def sql_bytes(v: str) -> str:
    return f"regexp_extract_all(hex({v}), '..')"


def sql_entropy(v: str, alpha: float) -> str:
    shares = f"list_transform(map_values(list_aggregate({sql_bytes(v)}, 'histogram')), lambda c: c / CAST(octet_length(encode({v})) AS DOUBLE))"
    if alpha == 1:
        body = f"-list_sum(list_transform({shares}, lambda p: p * log2(p)))"
    else:
        body = f"log2(list_sum(list_transform({shares}, lambda p: pow(p, {alpha})))) / {1 - alpha}"
    return f"(CASE WHEN octet_length(encode({v})) < 2 THEN 0 ELSE {body} END)"


def sql_charset(v: str) -> str:
    has = lambda x: f"regexp_matches({v}, '{x}')"
    low, up, dg = has("[a-z]"), has("[A-Z]"), has("[0-9]")
    return (
        f"(CASE WHEN {has('[^0-9A-Za-z+/=_-]')} THEN 'printable' WHEN {has('[+/=_-]')} THEN 'base64' WHEN {dg} AND NOT {low} AND NOT {up} THEN 'digits' "
        f"WHEN {dg} AND {low} AND NOT {up} AND NOT {has('[g-z]')} THEN 'hex' WHEN {dg} AND {up} AND NOT {low} AND NOT {has('[G-Z]')} THEN 'hex' "
        f"WHEN {low} AND {up} AND {dg} THEN 'alphanum' WHEN {low} AND {up} THEN 'alpha' WHEN {low} AND {dg} THEN 'lowernum' "
        f"WHEN {up} AND {dg} THEN 'uppernum' WHEN {low} THEN 'lower' ELSE 'upper' END)"
    )


def sql_size(name: str) -> str:
    return "(CASE " + name + " " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in V.CHARSET_SIZES.items()) + " END)"


def sql_score(v: str) -> str:
    n, k = f"CAST(octet_length(encode({v})) AS DOUBLE)", sql_size(sql_charset(v))
    expected = f"(-log2(1 / {n} + ({n} - 1) / ({n} * {k})))"
    return f"(CASE WHEN {n} < 2 THEN 0 ELSE least(1.25, greatest(0, {sql_entropy(v, 2)} / {expected})) END)"


def sql_placeholder(v: str) -> str:
    """Counting runs by their differences: six bytes in a row are five equal steps."""
    codes = f"list_transform({sql_bytes(v)}, lambda h: CAST(('0x' || h) AS INTEGER))"
    steps = f"list_transform(list_zip({codes}, list_slice({codes}, 2, len({codes}))), lambda z: CASE z[2] - z[1] WHEN 1 THEN 'u' WHEN -1 THEN 'd' ELSE '.' END)"
    run = f"regexp_matches(array_to_string({steps}, ''), 'u{{5}}|d{{5}}')"
    repeat = "(" + " OR ".join(f"contains({v}, repeat(chr({c}), 5))" for c in range(32, 127)) + ")"
    n = f"octet_length(encode({v}))"
    few = f"len(list_distinct({sql_bytes(v)})) < least(12, greatest(5, {n} // 5))"
    return f"({sql_any(f'lower({v})', V.STOPWORDS)} OR {repeat} OR {run} OR {few})"


def sql_digits(v: str) -> str:
    return f"(regexp_matches({v}, '[0-9][^0-9]*[0-9]') OR regexp_matches({v}, '[+=]'))"


def sql_re(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def sql_base(path: str) -> str:
    return f"lower(regexp_extract({path}, '([^/]*)$', 1))"


def sql_folders(path: str) -> str:
    return f"list_filter(string_split({path}, '/')[:-2], lambda s: s <> '' AND s <> '.')"


def sql_test_path(path: str) -> str:
    folder = f"len(list_filter({sql_folders(path)}, lambda s: {sql_in('lower(s)', V.TEST_DIRECTORIES)} OR {sql_re('s', V.TEST_DIRECTORY_SHAPE)})) > 0"
    return f"({folder} OR {sql_re(sql_base(path), r'^(?:test|mock)|[_.]test[.]|-test|test-|[._]spec[.]')})"


def sql_doc_file(path: str) -> str:
    return f"({sql_in(sql_base(path), V.DOC_NAMES)} OR {sql_re(sql_base(path), '[.](?:' + '|'.join(V.DOC_EXTENSIONS) + ')$')})"


def sql_non_prod(path: str) -> str:
    folder = f"len(list_filter({sql_folders(f'lower({path})')}, lambda s: {sql_in('s', V.NON_PROD_DIRECTORIES)})) > 0"
    token = f"len(list_filter(regexp_split_to_array({sql_base(path)}, '[^a-z0-9]+'), lambda s: {sql_in('s', V.NON_PROD_TOKENS)})) > 0"
    return f"({folder} OR {sql_doc_file(path)} OR {token})"


def sql_key_material(path: str) -> str:
    base = sql_base(path)
    return f"({sql_re(base, '[.](?:' + '|'.join(V.KEY_MATERIAL_EXTENSIONS) + ')$')} OR {sql_re(base, V.KEY_MATERIAL_NAME)})"


def sql_needs_quotes(path: str) -> str:
    base = sql_base(path)
    return f"({sql_re(base, '^(?:' + '|'.join(V.PROSE_NAMES) + ')')} OR {sql_re(base, '^.+[.](?:' + '|'.join(V.QUOTED_EXTENSIONS) + ')$')})"


def sql_redact(v: str) -> str:
    return f"(CASE WHEN length({v}) = 0 THEN '' WHEN length({v}) < 8 THEN '****' WHEN length({v}) < 16 THEN substr({v}, 1, 2) || '****' ELSE substr({v}, 1, 4) || '****' || right({v}, 4) END)"


def sql_fingerprint(rule: str, path: str, v: str) -> str:
    zero = r"'\x00'::BLOB"
    return f"substr(sha256(encode({rule}) || {zero} || encode({path}) || {zero} || unhex(sha256({v}))), 1, 32)"


# ---- sources and lines -------------------------------------------------------------------------------


@query("""
    SELECT doc_id AS unit_id, count(*) AS n_lines, CAST(sum(length(l)) AS BIGINT) AS chars, max(length(l)) AS longest
    FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '\\r$', '') AS l FROM documents) GROUP BY doc_id
""")
def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_lines(spark, sf_dir)
    return rows.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest")
    )


@query(f"""
    SELECT number, count(*) AS n FROM (SELECT number, CASE WHEN k % 5 = 0 THEN text || ' # gitleaks:allow' ELSE text END AS text FROM ({DERIVED}))
    WHERE text <> '' AND NOT {sql_any('text', V.ALLOW_MARKERS)} GROUP BY number
""")
def allow_marker_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(F.col("k") % 5 == 0, F.concat("text", F.lit(" # gitleaks:allow"))).otherwise(F.col("text"))
    rows = derived_lines(spark, sf_dir).withColumn("text", marked)
    return rows.where(lines.is_scannable(F.col("text"))).groupBy("number").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT page_id, CASE WHEN page_id % 10 = 0 THEN true ELSE false END AS is_binary, octet_length(encode(html)) AS bytes FROM pages
""")
def binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode("html", "UTF-8")
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 10 == 0, F.concat(F.unhex(F.lit("4100")), content)).otherwise(content).alias("content"), F.octet_length("html").alias("bytes"))
    return rows.select("page_id", F.expr(f"position(X'00', substring(content, 1, {V.SNIFFED_BYTES})) > 0").alias("is_binary"), F.col("bytes").cast("long").alias("bytes"))


@query(f"""
    SELECT path, count(*) AS n FROM ({PATHS}) WHERE NOT (
        contains('/' || path, '/node_modules/') OR path LIKE '%.min.js') GROUP BY path
""")
def path_ignore_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, PATHS)
    return rows.where(~P.matches_globs(F.col("path"), Config().scan.ignore_paths)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, octet_length(encode(text)) AS length FROM documents WHERE octet_length(encode(text)) <= 4096")
def size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("length"))
    return rows.where(F.col("length") <= 4096)


#: A commit for each order: a header, two files, context, removed and added lines.
DIFFS = r"""
    SELECT o_orderkey AS diff_id, concat(
        'diff --git a/src/f', CAST(o_orderkey % 7 AS STRING), '.py b/src/f', CAST(o_orderkey % 7 AS STRING), '.py', chr(10), '--- a/src/x.py', chr(10),
        '+++ b/src/f', CAST(o_orderkey % 7 AS STRING), '.py', chr(10), '@@ -1,2 +', CAST(o_orderkey % 90 + 1 AS STRING), ',3 @@', chr(10),
        ' context', chr(10), '-old', chr(10), '+new ', o_orderpriority, chr(10), '+more', chr(10), '@@ -40 +', CAST(o_orderkey % 90 + 50 AS STRING), ' @@ def f', chr(10),
        '+', md5(CAST(o_orderkey AS STRING)), chr(10), 'diff --git a/img.png b/img.png', chr(10), 'Binary files a/img.png and b/img.png differ') AS diff
    FROM orders"""


@query("""
    SELECT o_orderkey AS diff_id, 'src/f' || (o_orderkey % 7) || '.py' AS path, unnest([o_orderkey % 90 + 2, o_orderkey % 90 + 3, o_orderkey % 90 + 50]) AS number,
        unnest(['new ' || o_orderpriority, 'more', md5(CAST(o_orderkey AS VARCHAR))]) AS text FROM orders
""")
def diff_added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.added_lines(derived(spark, sf_dir, DIFFS)).select("diff_id", "path", F.col("number").cast("long").alias("number"), "text")


LOGS = r"""
    SELECT o_orderkey AS k, concat(chr(30), md5(CAST(o_orderkey AS STRING)), chr(31), 'dev', CAST(o_custkey AS STRING), chr(31), 'dev@example.org', chr(31), substr(CAST(o_orderdate AS STRING), 1, 10), chr(31),
        o_orderpriority, chr(10), 'diff --git a/a.txt b/a.txt', chr(10), '+++ b/a.txt', chr(10), '@@ -0,0 +1 @@', chr(10), '+', o_orderstatus, chr(30), 'broken', chr(31), 'record') AS log
    FROM orders"""


@query("""
    SELECT md5(CAST(o_orderkey AS VARCHAR)) AS hash, 'dev' || o_custkey AS author, 'dev@example.org' AS email, strftime(o_orderdate, '%Y-%m-%d') AS date,
        o_orderpriority AS message, 'a.txt' AS path, 1 AS number, o_orderstatus AS text FROM orders
""")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = diffs.log_records(derived(spark, sf_dir, LOGS))
    added = diffs.added_lines(commits, "hash", "body").select("hash", "path", "number", "text")
    return commits.drop("body").join(added, "hash")


@query(r"""
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'src/f' || conv_id || '.py' ELSE '<command>' END AS path, text FROM conversations
""")
def payload_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    write = F.to_json(F.struct(F.lit("Write").alias("tool_name"), F.lit("/work").alias("cwd"), F.struct(F.concat(F.lit("/work/src/f"), F.col("conv_id").cast("string"), F.lit(".py")).alias("file_path"), F.col("text").alias("content")).alias("tool_input")))
    run = F.to_json(F.struct(F.lit("Bash").alias("tool_name"), F.lit("/work").alias("cwd"), F.struct(F.col("text").alias("command")).alias("tool_input")))
    made = rows.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, write).otherwise(run).alias("payload"))
    return inputs.payload_units(made).select("conv_id", "turn", "path", "text")


# ---- scalar functions ---------------------------------------------------------------------------------


@query(f"SELECT k, v, {sql_charset('v')} AS charset, {sql_size(sql_charset('v'))} AS size FROM ({VALUES})")
def charset_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = X.charset_class(F.col("v"))
    return derived(spark, sf_dir, VALUES).select("k", "v", name.alias("charset"), X.charset_size(name).alias("size"))


def _renyi(alpha: float) -> Callable[[SparkSession, str], DataFrame]:
    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        return derived(spark, sf_dir, VALUES).select("k", F.round(X.renyi_entropy(F.col("v"), alpha), 6).alias("bits"))

    made.__name__ = f"renyi_alpha_{str(alpha).replace('.', '_').removesuffix('_0')}"
    return made


for _alpha in (0.5, 1.0, 2.0):
    query(f"SELECT k, round({sql_entropy('v', _alpha)}, 6) AS bits FROM ({VALUES})")(_renyi(_alpha))


@query("""
    SELECT DISTINCT l_linenumber + CAST(l_quantity AS INT) AS n, l_linenumber * 8 AS size,
        round(CASE WHEN l_linenumber + CAST(l_quantity AS INT) < 2 THEN 0 ELSE -log2(1.0 / (l_linenumber + CAST(l_quantity AS INT)) + (l_linenumber + CAST(l_quantity AS INT) - 1.0) / ((l_linenumber + CAST(l_quantity AS INT)) * l_linenumber * 8.0)) END, 6) AS bits
    FROM lineitem
""")
def expected_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") + F.round("l_quantity").cast("int")).alias("n"), (F.col("l_linenumber") * 8).alias("size")).distinct()
    return rows.select("n", "size", F.round(X.expected_collision(F.col("n"), F.col("size")), 6).alias("bits"))


@query(f"SELECT k, round({sql_score('v')}, 6) AS score FROM ({VALUES})")
def normalized_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, VALUES).select("k", F.round(X.normalized_score(F.col("v")), 6).alias("score"))


@query(f"SELECT k, v, {sql_placeholder('v')} AS placeholder, {sql_digits('v')} AS digits FROM ({VALUES})")
def placeholder_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, VALUES).select("k", "v", X.is_placeholder(F.col("v")).alias("placeholder"), X.has_digit_or_symbol(F.col("v")).alias("digits"))


_WORDS = {
    "AdminPassword": (["admin", "password"], 4), "IRC_PASS": (["irc", "pass"], 4), "APIKey": (["api", "key"], 3), "db.user": (["db", "user"], 1),
    "token_type": (["token", "type"], 0), "access_key_id": (["access", "key", "id"], 1), "PASS": (["pass"], 0), "publicKey": (["public", "key"], 0),
    "sessionKey": (["session", "key"], 2), "compass": (["compass"], 0), "client-secret": (["client", "secret"], 3),
}


@query(
    f"SELECT k, name, CASE name {' '.join(f'WHEN {q(n)} THEN {w}' for n, (w, _) in _WORDS.items())} ELSE list_transform(regexp_extract_all(name, '[A-Za-z0-9]+'), lambda x: lower(x)) END AS words FROM ({NAMES})"
)
def split_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, NAMES).select("k", "name", K.key_words(F.col("name")).alias("words"))


@query(f"SELECT k, name, CASE name {' '.join(f'WHEN {q(n)} THEN {c}' for n, (_, c) in _WORDS.items())} ELSE 0 END AS class FROM ({NAMES})")
def classify_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, NAMES).select("k", "name", K.classify_key(F.col("name")).alias("class"))


@query(f"SELECT k, {sql_redact('v')} AS masked FROM ({VALUES})")
def redact_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, VALUES).select("k", S.redact(F.col("v")).alias("masked"))


@query(f"SELECT k, replace('x=' || v || '; y=' || v, v, {sql_redact('v')}) AS shown FROM ({VALUES})")
def redact_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("x="), "v", F.lit("; y="), "v")
    return derived(spark, sf_dir, VALUES).select("k", S.redact_in(text, F.col("v")).alias("shown"))


@query(f"SELECT k, {sql_fingerprint(q('generic-secret-assignment'), 'path', 'text')} AS fingerprint FROM ({DERIVED})")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_lines(spark, sf_dir).select("k", S.fingerprint(F.lit("generic-secret-assignment"), F.col("path"), F.col("text")).alias("fingerprint"))


def _sql_field(v: str) -> str:
    return f"unhex(printf('%016x', octet_length(encode({v})))) || encode({v})"


@query(
    f"SELECT k, sha256({' || '.join(map(_sql_field, (q('r'), 'path', 'text', 'text', q(''), q(''), q('1'))))}) AS key FROM ({DERIVED})"
)
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.concat(F.col("number").cast("string"), F.lit(": "), "text")
    none = F.lit("")
    return derived_lines(spark, sf_dir).select("k", S.cache_key(F.lit("r"), F.col("path"), F.col("text"), context, none, none, F.lit(1)).alias("key"))


def _path_query(name: str, made: Callable, sql: Callable[[str], str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = derived(spark, sf_dir, PATHS)
        return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", "n", made(F.col("path")).alias("flag"))

    run.__name__ = name
    query(f"SELECT path, n, {sql('path')} AS flag FROM (SELECT path, count(*) AS n FROM ({PATHS}) GROUP BY path)")(run)


for _name, _made, _sql in (
    ("test_path", P.is_test_path, sql_test_path), ("nonprod_path", P.is_non_prod, sql_non_prod), ("key_material_path", P.is_key_material, sql_key_material),
    ("needs_quotes", P.needs_quotes, sql_needs_quotes), ("doc_file", P.is_doc_file, sql_doc_file),
    ("credential_file", P.is_credential_file, lambda p: f"(regexp_matches({p}, '/secrets[.]yml$'))"),
):
    _path_query(_name, _made, _sql)


# ---- detection -----------------------------------------------------------------------------------------

@query(
    "SELECT rule_id, count(*) AS n FROM ("
    + " UNION ALL ".join(
        f"SELECT {q(r.id)} AS rule_id FROM ({DERIVED}) WHERE {sql_any('lower(text)', r.keywords)}" for r in builtin()
    )
    + ") GROUP BY rule_id"
)
def keyword_prescreen(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    gates = F.array(*(F.when(X.contains_any(low, r.keywords), F.lit(r.id)) for r in builtin()))
    rows = derived_lines(spark, sf_dir).select(F.explode(F.array_compact(gates)).alias("rule_id"))
    return rows.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def rule_hits(rows: DataFrame) -> DataFrame:
    """Stage one as one projection: for each rule its keyword gate and its matches; only hits are exploded and guarded."""
    low, text = F.lower("text"), F.col("text")
    kind = "array<struct<rule_id:string,severity:string,floor:double,secret:string>>"

    def hits(r: Rule) -> Column:
        def named(v: Column) -> Column:
            return F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.floor).cast("double").alias("floor"), v.alias("secret"))

        pattern = for_jvm(r.pattern)
        secrets = F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(r.group)), 1, V.MATCHES_A_LINE)
        return F.when(X.contains_any(low, r.keywords) & text.rlike(pattern), F.transform(secrets, named)).otherwise(F.array().cast(kind))

    found = rows.withColumn("hit", F.explode(F.flatten(F.array(*map(hits, builtin()))))).select("*", "hit.*").drop("hit")
    known = F.lit(False)
    for r in builtin():
        for allowed in r.allowed:
            known = known | ((F.col("rule_id") == r.id) & F.col("secret").rlike(for_jvm(allowed)))
    secret = F.col("secret")
    passed = F.col("floor").isNull() | (X.normalized_score(secret) >= F.col("floor"))
    return found.where(~known & ~X.is_placeholder(secret) & passed).drop("floor")


@query(
    "SELECT rule_id, severity, count(*) AS n, count(DISTINCT secret) AS secrets FROM ("
    + " UNION ALL ".join(
        f"SELECT {q(r.id)} AS rule_id, {q(r.severity)} AS severity, secret FROM (SELECT unnest(regexp_extract_all(text, {q(r.pattern)}, {r.group})) AS secret FROM ({DERIVED}) WHERE {sql_any('lower(text)', r.keywords)})"
        + f" WHERE NOT {sql_placeholder('secret')}"
        + (f" AND {sql_score('secret')} >= {r.floor}" if r.floor else "")
        + "".join(f" AND NOT {sql_re('secret', x)}" for x in r.allowed)
        for r in builtin()
    )
    + ") GROUP BY rule_id, severity"
)
def rule_hits_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_hits(derived_lines(spark, sf_dir)).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("secret").alias("secrets"))


@query(f"SELECT k, {sql_score('v')} >= 0.55 AS passes FROM ({VALUES})")
def rule_guard_entropy_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, VALUES).select("k", (X.normalized_score(F.col("v")) >= 0.55).alias("passes"))


@query(f"""
    SELECT doc_id, count(*) AS tokens, CAST(sum(length(t)) AS BIGINT) AS chars FROM
    (SELECT doc_id, unnest(regexp_extract_all(l, '{V.TOKEN_RUN}={{0,2}}')) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) GROUP BY doc_id
""")
def token_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tokens = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({V.TOKEN_RUN}={{0,2}})"), F.lit(1))).alias("t"))
    return tokens.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.length("t")).alias("chars"))


_SWEEP = f"""
    SELECT k, path, number, text, t AS secret, CASE WHEN near THEN 'high' ELSE 'medium' END AS severity FROM (
        SELECT *, {sql_any('lower(text)', V.CONTEXT_KEYWORDS)} AS near FROM (SELECT *, unnest(regexp_extract_all(text, '{V.TOKEN_RUN}={{0,2}}')) AS t FROM ({{source}})))
    WHERE length(t) BETWEEN 20 AND 512 AND NOT {sql_re('t', V.UUID)} AND {sql_digits('t')}
        AND NOT ({sql_re('t', V.HEX)} AND length(t) = 40 AND {sql_any('lower(text)', V.GIT_SHA_CONTEXT)})
        AND NOT ({sql_re('t', V.HEX)} AND length(t) IN (64, 128) AND {sql_any('lower(text)', V.DIGEST_CONTEXT)})
        AND NOT {sql_placeholder('t')} AND {sql_score('t')} >= CASE WHEN near THEN 0.88 ELSE 0.95 END"""


@query(f"SELECT path, severity, count(*) AS n, count(DISTINCT secret) AS secrets FROM ({_SWEEP.replace("{source}", DERIVED)}) GROUP BY path, severity")
def generic_high_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native_sweep(derived_lines(spark, sf_dir)).groupBy("path", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("secret").alias("secrets"))


@query("""
    SELECT doc_id, 'generic-secret-assignment' AS rule_id, count(DISTINCT secret) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_$@.-])(?:token|secret|api_key) ?[:=] ?"([0-9a-f]{40})"', 1)) AS secret FROM documents)
    GROUP BY doc_id
""")
def assigned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values bound to token names in documents, by the whole scan; the SQL says the one shape that the documents hold."""
    units = units_of_table(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = findings(units).where("rule_id = 'generic-secret-assignment'")
    return found.groupBy(F.col("unit_id").cast("long").alias("doc_id"), "rule_id").agg(F.count_distinct("secret").alias("n"))


@query(f"""
    SELECT k, key, sign, value FROM (SELECT k, regexp_extract(text, {q(V.ASSIGNMENT)}, 2) AS key, regexp_extract(text, {q(V.ASSIGNMENT)}, 4) AS sign,
        regexp_extract(text, {q(V.ASSIGNMENT)} || '"([^"]*)"', 5) AS value FROM ({DERIVED})) WHERE key <> ''
""")
def assignment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = for_jvm(V.ASSIGNMENT)
    rows = derived_lines(spark, sf_dir).select("k", F.regexp_extract("text", pattern, 2).alias("key"), F.regexp_extract("text", pattern, 4).alias("sign"), F.regexp_extract("text", pattern + '"([^"]*)"', 5).alias("value"))
    return rows.where("key != ''")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan of derived lines, a unit each."""
    rows = derived_lines(spark, sf_dir)
    units = rows.select(F.col("k").cast("string").alias("unit_id"), "path", "text", F.array("number").alias("numbers"))
    return findings(units).withColumn("k", F.col("unit_id").cast("long"))


@query(f"SELECT k, regexp_extract(text, 'amqp://svc:([0-9a-f]+)@', 1) AS secret, 'high' AS severity FROM ({DERIVED}) WHERE contains(text, 'amqp://')")
def url_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).where("rule_id = 'url-credentials'").select("k", "secret", "severity")


@query(f"""SELECT k, regexp_extract(text, 'login."svc", "([^"]*)"', 1) AS secret FROM ({DERIVED}) WHERE contains(text, 'login(') AND NOT {sql_any("lower(regexp_extract(text, '[^ ]*$'))", V.STOPWORDS)}""")
def login_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived_lines(spark, sf_dir).where(F.contains("text", F.lit("login("))).select("k")
    return _scanned(spark, sf_dir).where("rule_id = 'generic-password-assignment'").join(rows, "k", "left_semi").select("k", "secret")


@query(f"SELECT k, regexp_extract(text, '<Password>([^<]+)</Password>', 1) AS secret FROM ({DERIVED}) WHERE contains(text, '<Password>')")
def xml_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived_lines(spark, sf_dir).where(F.contains("text", F.lit("<Password>"))).select("k")
    return _scanned(spark, sf_dir).where("rule_id = 'generic-password-assignment'").join(rows, "k", "left_semi").select("k", "secret")


@query(f"SELECT k, regexp_extract(text, 'password (\\S+)', 1) AS secret FROM ({DERIVED}) WHERE text LIKE 'machine %' AND NOT {sql_needs_quotes('path')}")
def netrc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived_lines(spark, sf_dir).where("text like 'machine %'").select("k")
    return _scanned(spark, sf_dir).where("rule_id = 'generic-password-assignment'").join(rows, "k", "left_semi").select("k", "secret")


BLOCKS = """
    SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN concat('db:', chr(10), '  password: |', chr(10), '    ', substr(md5(p_name), 1, 12), chr(10), '    ', substr(md5(p_name), 13, 8), chr(10), 'next: 1')
        WHEN 1 THEN concat('PASSWORD = ', chr(92), chr(10), '    ', substr(md5(p_name), 1, 16)) ELSE concat('password:', chr(10), chr(10), '    ', substr(md5(p_name), 1, 16)) END AS text
    FROM part"""


@query("""
    SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN substr(md5(p_name), 1, 12) || chr(10) || substr(md5(p_name), 13, 8) ELSE substr(md5(p_name), 1, 16) END AS secret,
        CASE p_partkey % 3 WHEN 0 THEN 3 ELSE 2 END AS line FROM part WHERE p_partkey % 3 < 2
""")
def next_line_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = units_of_table(derived(spark, sf_dir, BLOCKS), "k", "text", F.lit("conf/app.conf"))
    found = findings(units).where("rule_id = 'generic-password-assignment'")
    return found.select(F.col("unit_id").cast("long").alias("k"), "secret", "line")


@query("SELECT c_custkey AS k, 'db' || c_custkey || ':5432:app:svc:' || substr(md5(c_name), 1, 12) AS secret, 'high' AS severity FROM customer WHERE c_custkey % 4 > 0")
def credential_file_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.concat(F.lit("db"), F.col("c_custkey").cast("string"), F.lit(":5432:app:svc:"), F.substring(F.md5("c_name"), 1, 12))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("# "), record)).otherwise(record).alias("text"))
    found = findings(units_of_table(rows, "c_custkey", "text", F.lit("home/.pgpass"))).where("rule_id = 'credential-file-entry'")
    return found.select(F.col("unit_id").cast("long").alias("k"), "secret", "severity")


@query("SELECT c_custkey AS k, 'user ' || c_name || ' ok' AS text FROM customer")
def decode_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.concat(F.lit("user "), "c_name", F.lit(" ok"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.base64(F.encode(plain, "UTF-8")).alias("v"))
    return rows.select("k", S.decode_base64(F.col("v")).alias("text"))


@query("SELECT c_custkey AS k, CASE WHEN length(c_name) >= 8 THEN c_name END AS text FROM customer")
def decode_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lower(F.hex("c_name")).alias("v"))
    return rows.select("k", S.decode_hex(F.col("v")).alias("text"))


@query("SELECT c_custkey AS k, 'name=' || c_name || ' & more=' || c_custkey || '%' AS text FROM customer")
def decode_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("name="), F.replace("c_name", F.lit("#"), F.lit("%23")), F.lit("%20%26 more="), F.col("c_custkey").cast("string"), F.lit("%25"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), line.alias("v"))
    return rows.select("k", S.decode_percent(F.col("v")).alias("text"))


@query("SELECT c_custkey AS k, 'café ' || c_name AS text FROM customer")
def decode_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("caf\\u00e9 "), "c_name").alias("v"))
    return rows.select("k", S.decode_unicode_escapes(F.col("v")).alias("text"))


@query("SELECT c_custkey AS k, 'generic-password-assignment' AS rule_id, 'S' || substr(md5(c_name), 1, 10) || '!' AS secret, 1 AS line, true AS tagged FROM customer")
def decode_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.concat(F.lit('password = "S'), F.substring(F.md5("c_name"), 1, 10), F.lit('!"'))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("data: "), F.base64(F.encode(plain, "UTF-8"))).alias("text"))
    found = findings(units_of_table(rows, "c_custkey", "text", F.lit("a.conf"))).where("rule_id = 'generic-password-assignment'")
    return found.select(F.col("unit_id").cast("long").alias("k"), "rule_id", "secret", "line", F.array_contains("tags", "decoded:base64").alias("tagged"))


@query("""
    WITH s AS (SELECT l_orderkey AS unit_id, CAST(l_linenumber AS INT) AS idx, CAST(floor(l_quantity) AS INT) AS start_b, CAST(floor(l_quantity) AS INT) + 10 AS end_b, l_suppkey % 2 AS stage FROM lineitem)
    SELECT unit_id, idx, start_b, end_b FROM s a WHERE stage = 1 AND NOT EXISTS
        (SELECT 1 FROM s b WHERE b.stage = 0 AND a.unit_id = b.unit_id AND a.idx % 2 = b.idx % 2 AND a.start_b < b.end_b AND a.end_b > b.start_b)
""")
def span_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    spans = rows.select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").cast("int").alias("idx"), (F.col("l_linenumber") % 2).alias("half"), F.floor("l_quantity").cast("int").alias("start_b"), (F.floor("l_quantity").cast("int") + 10).alias("end_b"), (F.col("l_suppkey") % 2).alias("stage"))
    later, claimed = spans.where("stage = 1"), spans.where("stage = 0")
    return lines.without_overlaps(later, claimed, ("unit_id", "half")).select("unit_id", "idx", "start_b", "end_b")


@query(r"""
    WITH l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, regexp_replace(text, '[^ -~]|\s', ' ', 'g') AS text FROM conversations),
    p AS (SELECT a.conv_id, a.number, m.number AS k, m.number || ': ' || CASE WHEN length(m.text) > 200 THEN substr(m.text, 1, 200) || '…' ELSE m.text END || chr(10) AS t
          FROM l a JOIN l m ON a.conv_id = m.conv_id AND m.number BETWEEN a.number - 3 AND a.number + 3),
    s AS (SELECT *, sum(strlen(t)) OVER (PARTITION BY conv_id, number ORDER BY k) AS size FROM p)
    SELECT conv_id, CAST(number AS INT) AS number, regexp_replace(string_agg(t, '' ORDER BY k), '\n$', '') AS context FROM s WHERE size <= 1500 GROUP BY conv_id, number
""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines with their whole windows, from whole texts."""
    rows = table(spark, sf_dir, "conversations").withColumn("idx", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    rows = rows.select("conv_id", "idx", (F.col("idx") + 1).alias("number"), F.regexp_replace("text", r"[^ -~]|\s", " ").alias("text"))
    return lines.with_context(rows, "conv_id").select("conv_id", "number", "context")


@query("""
    SELECT o_orderkey AS k, 'user=u' || o_custkey || ' (line 1); host=h' || o_orderkey || ' (line 3)' AS related FROM orders
""")
def related_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("user = u"), F.col("o_custkey").cast("string"), F.lit('\npassword = "'), F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 14), F.lit('"\nhost = h'), F.col("o_orderkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    found = findings(units_of_table(rows, "o_orderkey", "text", F.lit("app.conf"))).where("rule_id = 'generic-password-assignment'")
    return found.select(F.col("unit_id").cast("long").alias("k"), "related")


# ---- after detection --------------------------------------------------------------------------------------

#: A finding for each line item: files by order, lines by supplier, so runs of near lines occur.
FINDINGS = """
    SELECT concat('u', CAST(l_orderkey AS STRING)) AS unit_id, concat(CASE l_orderkey % 5 WHEN 0 THEN 'certs/k' WHEN 1 THEN 'tests/unit/t' ELSE 'src/f' END, CAST(l_orderkey % 200 AS STRING),
            CASE l_orderkey % 5 WHEN 0 THEN '.pem' WHEN 3 THEN '.md' ELSE '.py' END) AS file,
        CAST(row_number() OVER (PARTITION BY l_orderkey % 200 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_tax, l_discount, l_quantity) AS INT) AS ord,
        CASE l_partkey % 4 WHEN 0 THEN 'generic-high-entropy' WHEN 1 THEN 'generic-secret-assignment' WHEN 2 THEN 'aws-access-key-id' ELSE 'postgres-connection-uri' END AS rule_id,
        CAST(l_suppkey * 3 + l_linenumber * 2 AS INT) AS line, concat(CASE WHEN l_partkey % 4 = 2 THEN 'AKIA' ELSE '' END, substr(md5(CAST(l_partkey AS STRING)), 1, CAST(12 + l_partkey % 21 AS INT))) AS secret, l_discount + 0.82 AS entropy
    FROM lineitem"""


def synthetic_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, FINDINGS)
    severity = F.when(F.col("rule_id").startswith("generic"), "medium").otherwise("critical")
    tags = F.when(F.col("rule_id").startswith("generic"), F.array(F.lit("generic"))).when(F.col("rule_id") == "aws-access-key-id", F.array(F.lit("cloud"), F.lit("aws"))).otherwise(F.array(F.lit("database")))
    text = F.concat(F.lit("value = "), "secret")
    return rows.select(
        "unit_id", "file", "ord", "rule_id", F.col("rule_id").alias("description"), severity.alias("severity"), F.when(F.col("rule_id").startswith("generic"), 2).otherwise(4).alias("rank"),
        tags.alias("tags"), "line", F.lit(9).alias("column"), (F.length("secret") + 9).alias("end_column"), text.alias("line_text"), "secret", "entropy", F.lit(0.0).alias("entropy_bits"),
        F.concat(F.col("line").cast("string"), F.lit(": "), text).alias("context"), F.lit("").alias("related"), F.lit("").alias("decoded"),
        S.fingerprint(F.col("rule_id"), F.col("file"), F.col("secret")).alias("fingerprint"), F.lit(1).alias("occurrences"),
    )


@query(f"""
    WITH f AS ({FINDINGS}), g AS (SELECT *, CASE WHEN line - lag(line) OVER w <= 2 THEN 0 ELSE 1 END AS cut FROM f WINDOW w AS (PARTITION BY file, rule_id ORDER BY line, ord)),
    r AS (SELECT *, sum(cut) OVER (PARTITION BY file, rule_id ORDER BY line, ord) AS run FROM g),
    n AS (SELECT *, count(*) OVER (PARTITION BY file, rule_id, run) AS n, row_number() OVER (PARTITION BY file, rule_id, run ORDER BY line, ord) AS k FROM r)
    SELECT file, rule_id, line, CAST(CASE WHEN n >= 3 AND {sql_key_material('file')} THEN n ELSE 1 END AS INT) AS occurrences, count(*) AS rows FROM n
    WHERE NOT (n >= 3 AND {sql_key_material('file')}) OR k = 1 GROUP BY ALL
""")
def collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = after.collapsed(synthetic_findings(spark, sf_dir))
    return found.groupBy("file", "rule_id", "line", "occurrences").agg(F.count(F.lit(1)).alias("rows"))


_WITH_PRINT = f"SELECT *, {sql_fingerprint('rule_id', 'file', 'secret')} AS fingerprint FROM ({FINDINGS})"


@query(f"SELECT rule_id, count(*) AS n, count(DISTINCT fingerprint) AS prints FROM ({_WITH_PRINT}) WHERE fingerprint NOT IN (SELECT fingerprint FROM ({_WITH_PRINT}) WHERE line % 7 = 0) GROUP BY rule_id")
def baseline_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = synthetic_findings(spark, sf_dir)
    new, _ = after.split_by_baseline(found, found.where("line % 7 = 0"))
    return new.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fingerprint").alias("prints"))


@query(f"SELECT rule_id, count(*) AS n, count(DISTINCT fingerprint) AS prints FROM ({_WITH_PRINT}) WHERE fingerprint IN (SELECT fingerprint FROM ({_WITH_PRINT}) WHERE line % 7 = 0) GROUP BY rule_id")
def baseline_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = synthetic_findings(spark, sf_dir)
    _, known = after.split_by_baseline(found, found.where("line % 7 = 0"))
    return known.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fingerprint").alias("prints"))


_KEYED = f"""SELECT *, sha256({' || '.join(map(_sql_field, ('rule_id', 'file', 'secret', "'value = ' || secret", q(''), q(''), q('1'))))}) AS key FROM ({FINDINGS})"""


@query(f"""
    WITH k AS ({_KEYED}), ledger AS (SELECT DISTINCT key, 'secret' AS status FROM k WHERE rule_id = 'aws-access-key-id')
    SELECT k.rule_id, coalesce(l.status, 'asked') AS status, count(*) AS n FROM k LEFT JOIN ledger l USING (key) GROUP BY ALL
""")
def ledger_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = after.requests(synthetic_findings(spark, sf_dir))
    ledger = asked.where("rule_id = 'aws-access-key-id'").select("cache_key", F.lit("secret").alias("status")).distinct()
    rows = asked.join(ledger, "cache_key", "left")
    return rows.groupBy("rule_id", F.coalesce("status", F.lit("asked")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    SELECT batch_id, count(*) AS n, CAST(max(i) AS INT) AS last FROM (SELECT substr(key, 1, 2) || '-' || ((row_number() OVER w - 1) // 8) AS batch_id, (row_number() OVER w - 1) % 8 AS i
        FROM (SELECT DISTINCT key FROM ({_KEYED})) WINDOW w AS (PARTITION BY substr(key, 1, 2) ORDER BY key)) GROUP BY batch_id
""")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = after.requests(synthetic_findings(spark, sf_dir)).select("cache_key").distinct()
    return after.batched(asked, 8).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.max("index").alias("last"))


_VERDICT = f"""
    SELECT *, CASE WHEN {sql_any('lower(secret)', V.PLACEHOLDER_MARKERS)} THEN 'false_positive' WHEN generic AND ({sql_doc_file('file')} OR {sql_re('secret', V.BIG_INTEGER)}) THEN 'false_positive'
            WHEN generic AND {sql_non_prod('file')} THEN 'false_positive' WHEN generic THEN 'uncertain' ELSE 'secret' END AS status,
        CASE WHEN {sql_any('lower(secret)', V.PLACEHOLDER_MARKERS)} THEN 0.9 WHEN generic AND ({sql_doc_file('file')} OR {sql_re('secret', V.BIG_INTEGER)}) THEN 0.85 WHEN generic AND {sql_non_prod('file')} THEN 0.75
            WHEN NOT generic AND rule_id = 'aws-access-key-id' THEN 0.95 WHEN NOT generic AND entropy >= 0.85 THEN 0.9 WHEN NOT generic THEN 0.7 WHEN entropy >= 0.85 THEN 0.5 ELSE 0.4 END AS confidence
    FROM (SELECT *, rule_id LIKE 'generic%' AS generic FROM ({FINDINGS}))"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from credsieve.operators.judges import offline

    return offline(after.requests(synthetic_findings(spark, sf_dir)))


@query(f"SELECT rule_id, status, CAST(confidence AS DOUBLE) AS confidence, count(*) AS n FROM ({_VERDICT}) GROUP BY ALL")
def verdict_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir)
    return rows.groupBy("rule_id", F.col("verdict.status").alias("status"), F.col("verdict.confidence").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


_PARTED = f"""SELECT *, status = 'false_positive' AND NOT (rule_id = 'aws-access-key-id' AND NOT {sql_any('lower(secret)', V.PLACEHOLDER_MARKERS)} AND {sql_test_path('file')}) AS suppressed FROM ({_VERDICT})"""


@query(f"SELECT rule_id, suppressed, status, count(*) AS n FROM ({_PARTED}) GROUP BY ALL")
def fp_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = after.partitioned(_judged(spark, sf_dir))
    return rows.groupBy("rule_id", "suppressed", F.col("verdict.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT file, count(*) AS n FROM ({FINDINGS}) WHERE rule_id = 'aws-access-key-id' AND {sql_test_path('file')} AND NOT {sql_any('lower(secret)', V.PLACEHOLDER_MARKERS)} GROUP BY file")
def provider_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a verdict of false positive would not suppress."""
    wrong = F.struct(F.lit("false_positive").alias("status"), F.lit(0.9).alias("confidence"), F.lit("").alias("reason"))
    rows = after.partitioned(synthetic_findings(spark, sf_dir).withColumn("verdict", wrong))
    return rows.where("not suppressed").groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS n, count(DISTINCT file) AS files FROM ({FINDINGS}) WHERE rule_id NOT LIKE 'generic%'")
def severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return after.at_least(synthetic_findings(spark, sf_dir), "high").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))


# ---- reports ------------------------------------------------------------------------------------------------

_SEVERITY = "CASE WHEN rule_id LIKE 'generic%' THEN 'medium' ELSE 'critical' END"


def _parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return after.partitioned(_judged(spark, sf_dir))


@query(f"SELECT 'severity' AS dimension, {_SEVERITY} AS value, count(*) AS n FROM ({_VERDICT}) GROUP BY ALL UNION ALL SELECT 'verdict', status, count(*) FROM ({_VERDICT}) GROUP BY ALL")
def summary_by_severity_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary(_judged(spark, sf_dir))


@query(f"SELECT {_SEVERITY} AS severity, rule_id, count(*) AS n FROM ({FINDINGS}) GROUP BY ROLLUP ({_SEVERITY}, rule_id)")
def severity_rule_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic_findings(spark, sf_dir).rollup("severity", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT rule_id, CAST(row_number() OVER (ORDER BY first, rule_id) - 1 AS INT) AS rule_index FROM (SELECT rule_id, min(ord) AS first FROM ({FINDINGS}) GROUP BY rule_id)")
def sarif_rule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rule_index(synthetic_findings(spark, sf_dir)).select("rule_id", "rule_index")


@query(f"SELECT rule_id, CASE WHEN rule_id LIKE 'generic%' THEN 'warning' ELSE 'error' END AS level, suppressed, count(*) AS n, count(DISTINCT fingerprint) AS prints FROM (SELECT *, {sql_fingerprint('rule_id', 'file', 'secret')} AS fingerprint FROM ({_PARTED})) GROUP BY ALL")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.sarif_results(_parted(spark, sf_dir))
    return rows.groupBy("rule_id", "level", "suppressed").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fingerprint").alias("prints"))


@query(f"SELECT rule_id || ':' || file || ':' || line AS name, rule_id AS classname, {_SEVERITY} || ' secret at ' || file || ':' || line || ' (' || {sql_redact('secret')} || ')' AS failure, count(*) AS n FROM ({_PARTED}) WHERE NOT suppressed GROUP BY ALL")
def junit_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.junit_cases(_parted(spark, sf_dir)).where("not suppressed")
    return rows.groupBy("name", "classname", "failure").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {sql_fingerprint('rule_id', 'file', 'secret')} AS id, CASE WHEN rule_id LIKE 'generic%' THEN 'Medium' ELSE 'Critical' END AS severity, rule_id || ' [' || status || ']: ' || {sql_redact('secret')} AS description, count(*) AS n FROM ({_PARTED}) WHERE NOT suppressed GROUP BY ALL")
def gitlab_vulns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.gitlab_vulnerabilities(_parted(spark, sf_dir))
    return rows.groupBy("id", "severity", "description").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    SELECT file, line, '  [' || {_SEVERITY} || '] ' || rule_id || '  ' || line || ':9  ' || {sql_redact('secret')} || chr(10) || '    verdict: ' || status || printf(' (confidence %.2f)', CAST(confidence AS DOUBLE))
        || chr(10) || '    | value = ' || {sql_redact('secret')} AS block, count(*) AS n FROM ({_PARTED}) WHERE NOT suppressed GROUP BY ALL
""")
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.text_lines(_parted(spark, sf_dir).where("not suppressed"))
    return rows.groupBy("file", "line", "block").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(DISTINCT file) AS files, count(*) AS n FROM ({FINDINGS})")
def files_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic_findings(spark, sf_dir).agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("n"))


# ---- metrics --------------------------------------------------------------------------------------------------

_LABELS = "SELECT 'p' || (o_orderkey % 300) AS path, o_custkey % 400 AS start, o_custkey % 400 + 3 AS stop, CASE o_orderkey % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'F' ELSE 'X' END AS label FROM orders"
_HITS = "SELECT 'p' || (p_partkey % 300) AS path, p_partkey % 400 AS lo, p_partkey % 400 + 1 AS hi, p_partkey AS id FROM part"


def _hits_and_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    marks = table(spark, sf_dir, "orders").selectExpr(
        "concat('p', o_orderkey % 300) AS path", "o_custkey % 400 AS start", "o_custkey % 400 + 3 AS `end`", "CASE o_orderkey % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'F' ELSE 'X' END AS label"
    )
    hits = table(spark, sf_dir, "part").selectExpr("concat('p', p_partkey % 300) AS path", "p_partkey % 400 AS lo", "p_partkey % 400 + 1 AS hi", "p_partkey AS id")
    return hits, marks


@query(f"""
    WITH l AS ({_LABELS}), h AS ({_HITS}), m AS (SELECT h.id, max(CASE l.label WHEN 'T' THEN 3 WHEN 'F' THEN 2 WHEN 'X' THEN 1 END) AS best FROM h LEFT JOIN l ON h.path = l.path AND l.start <= h.hi AND h.lo <= l.stop GROUP BY h.id)
    SELECT CASE best WHEN 3 THEN 'T' WHEN 2 THEN 'F' WHEN 1 THEN 'X' ELSE 'none' END AS label, count(*) AS n FROM m GROUP BY ALL
""")
def label_interval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, marks = _hits_and_labels(spark, sf_dir)
    return metrics.labelled(hits, marks).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH l AS ({_LABELS}), h AS ({_HITS}), m AS (SELECT h.id, max(CASE l.label WHEN 'T' THEN 3 WHEN 'F' THEN 2 WHEN 'X' THEN 1 END) AS best FROM h LEFT JOIN l ON h.path = l.path AND l.start <= h.hi AND h.lo <= l.stop GROUP BY h.id),
    a AS (SELECT count(*) FILTER (best = 3) AS hits, count(*) FILTER (best >= 2) AS judged FROM m),
    b AS (SELECT count(*) FILTER (label = 'T') AS all_true, count(*) FILTER (label = 'T' AND EXISTS (SELECT 1 FROM h WHERE h.path = l.path AND l.start <= h.hi AND h.lo <= l.stop)) AS true_found FROM l)
    SELECT hits, judged, true_found, all_true, round(hits / judged, 9) AS precision, round(true_found / all_true, 9) AS recall FROM a, b
""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.precision_recall(*_hits_and_labels(spark, sf_dir))
    return rows.select("hits", "judged", "true_found", "all_true", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("""
    WITH e AS (SELECT o_orderkey, count(*) AS expected FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1), f AS (SELECT l_orderkey, count(*) AS found FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
    SELECT CAST(sum(least(coalesce(found, 0), expected - 1)) AS BIGINT) AS covered, CAST(sum(expected - 1) AS BIGINT) AS expected, count(*) FILTER (coalesce(found, 0) > 0 AND expected > 1) AS files_covered,
        CAST(sum(greatest(coalesce(found, 0) - (expected - 1), 0)) AS BIGINT) AS overage FROM e LEFT JOIN f ON o_orderkey = l_orderkey
""")
def capped_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count(F.lit(1)) - 1).alias("expected"), F.count_if(F.col("l_returnflag") != "N").alias("found"))
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return metrics.capped_coverage(items.join(known, "l_orderkey", "left_semi"))


@query("""
    WITH r AS (SELECT round(l_extendedprice, -2) AS s, l_returnflag = 'R' AS p FROM lineitem), k AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM r)
    SELECT round((sum(rk) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2.0) / (count(*) FILTER (p) * count(*) FILTER (NOT p)), 9) AS auc FROM k
""")
def auc_ranksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.round("l_extendedprice", -2).alias("score"), (F.col("l_returnflag") == "R").alias("positive"))
    return metrics.auc(rows).select(F.round("auc", 9).alias("auc"))


@query("""
    WITH r AS (SELECT round(l_extendedprice, -2) AS s, l_returnflag = 'R' AS p FROM lineitem),
    t AS (SELECT s, row_number() OVER (ORDER BY s DESC) AS k, count(*) OVER () AS n FROM r WHERE p), c AS (SELECT max(s) AS threshold FROM t WHERE k >= 0.9 * n)
    SELECT threshold, count(*) FILTER (NOT p AND s >= threshold) AS false_positives FROM r, c GROUP BY threshold
""")
def fp_at_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.round("l_extendedprice", -2).alias("score"), (F.col("l_returnflag") == "R").alias("positive"))
    return metrics.false_positives_at(rows, 0.9)


@query("""
    WITH c AS (SELECT o_orderpriority AS stratum, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS hits FROM orders GROUP BY 1), p AS (SELECT *, hits / n AS p FROM c)
    SELECT stratum, n, hits, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS low,
        round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS high FROM p
""")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("hits"))
    low, high = metrics.wilson(F.col("hits"), F.col("n"))
    return rows.select("stratum", "n", "hits", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("""
    SELECT stratum, key FROM (SELECT o_orderpriority AS stratum, o_orderkey AS key, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('0:' || o_orderkey)) AS k FROM orders) WHERE k <= 25
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stratum"), F.col("o_orderkey").alias("key"))
    return metrics.stratified_sample(rows, "stratum", "key", 25)


@query("""
    WITH c AS (SELECT l_shipmode AS category, count(*) AS n, count(*) FILTER (l_returnflag <> 'N') AS hits FROM (SELECT *, 's' || (l_suppkey % 7) AS l_shipmode FROM lineitem) GROUP BY 1)
    SELECT category, n, hits, round(hits / n, 9) AS recall, n - hits AS missed, round(sum(n - hits) OVER (ORDER BY n - hits DESC, category) / sum(n - hits) OVER (), 9) AS missed_so_far FROM c
""")
def category_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("category"), (F.col("l_returnflag") != "N").alias("hit"))
    return metrics.category_recall(rows).withColumns({"recall": F.round("recall", 9), "missed_so_far": F.round("missed_so_far", 9)})


@query(f"SELECT rule_id, count(*) AS n FROM ({FINDINGS}) GROUP BY rule_id")
def by_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_rule(synthetic_findings(spark, sf_dir))


@query(f"SELECT file, count(*) AS n FROM ({FINDINGS}) GROUP BY file ORDER BY n DESC, file LIMIT 10")
def top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the ten files with most findings."""
    counts = synthetic_findings(spark, sf_dir).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return metrics.top(counts, "file", 10)


@query(f"""
    SELECT file, CASE max(CASE status WHEN 'secret' THEN 4 WHEN 'uncertain' THEN 3 WHEN 'unverified' THEN 2 WHEN 'false_positive' THEN 1 ELSE 0 END)
        WHEN 4 THEN 'secret' WHEN 3 THEN 'uncertain' WHEN 2 THEN 'unverified' WHEN 1 THEN 'false_positive' END AS status FROM ({_VERDICT}) GROUP BY file
""")
def best_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_verdict(_judged(spark, sf_dir).select("file", F.col("verdict.status").alias("status")))


@query(f"""
    WITH f AS (SELECT file, line, count(*) AS n FROM ({FINDINGS}) GROUP BY ALL), j AS (SELECT file, line, max(l_discount) AS probability FROM (SELECT f.*, entropy - 0.82 AS l_discount FROM ({FINDINGS}) f WHERE rule_id = 'aws-access-key-id') GROUP BY ALL)
    SELECT file, line, n, round(coalesce(probability, 0), 6) AS probability FROM f LEFT JOIN j USING (file, line)
""")
def judge_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = synthetic_findings(spark, sf_dir)
    judged = found.where("rule_id = 'aws-access-key-id'").select("file", "line", (F.col("entropy") - 0.82).alias("probability"))
    rows = metrics.with_probability(found.groupBy("file", "line").agg(F.count(F.lit(1)).alias("n")), judged)
    return rows.select("file", "line", "n", F.round("probability", 6).alias("probability"))


@query(f"""
    WITH f AS (SELECT DISTINCT {sql_fingerprint('rule_id', 'file', 'secret')} AS fingerprint, rule_id FROM ({FINDINGS})), a AS (SELECT DISTINCT fingerprint FROM f WHERE rule_id <> 'aws-access-key-id'), b AS (SELECT DISTINCT fingerprint FROM f WHERE rule_id <> 'postgres-connection-uri')
    SELECT count(*) FILTER (a.fingerprint = b.fingerprint) AS both, count(*) FILTER (b.fingerprint IS NULL) AS missing, count(*) FILTER (a.fingerprint IS NULL) AS unexpected FROM a FULL JOIN b ON a.fingerprint = b.fingerprint
""")
def sampled_and_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the judged fingerprints are the sampled ones: here each side lacks the findings of one rule."""
    found = synthetic_findings(spark, sf_dir)
    return metrics.set_check(found.where("rule_id <> 'aws-access-key-id'"), found.where("rule_id <> 'postgres-connection-uri'"))


@query(f"SELECT lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) AS extension, count(*) AS n, count(*) FILTER (o % 3 = 0) AS hits, round(count(*) FILTER (o % 3 = 0) / count(*), 9) AS recall FROM ({PATHS}) GROUP BY 1")
def extension_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, PATHS).select("path", (F.col("o") % 3 == 0).alias("hit"))
    return metrics.extension_recall(rows).withColumn("recall", F.round("recall", 9))


@query(f"SELECT rule_id, round(avg(entropy), 9) AS mean FROM ({FINDINGS}) GROUP BY rule_id")
def mean_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic_findings(spark, sf_dir).groupBy("rule_id").agg(F.round(F.avg("entropy"), 9).alias("mean"))


@query(f"SELECT {sql_charset('v')} AS charset, count(*) AS n FROM ({VALUES}) GROUP BY 1")
def charset_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, VALUES).groupBy(X.charset_class(F.col("v")).alias("charset")).agg(F.count(F.lit(1)).alias("n"))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("v"))
    return metrics.bootstrap_interval(rows, "v", 50)


# ---- windows over time ------------------------------------------------------------------------------------------


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def findings_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.tumbling(_timed(spark, sf_dir), "1 hour", "event_type")
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * h AS window_start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS h) GROUP BY ALL")
def findings_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.sliding(_timed(spark, sf_dir), "2 hours", "1 hour")
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("""
    WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS window_start, count(*) AS n FROM s GROUP BY user_id, k
""")
def findings_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.sessions(_timed(spark, sf_dir), "6 hours", "user_id")
    return rows.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


# ---- whole scans ----------------------------------------------------------------------------------------------------


@query()
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through all stages, collapsed and judged; public columns."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return Engine(spark).scan(units_of_table(docs, "doc_id", "text", path)).public().drop("ord")


@query()
def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    return Engine(spark).scan(units_of_table(pages, "page_id", "html", path)).public().drop("ord")


@query()
def hook_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived lines as writes of a tool: those that are stopped."""
    given = F.struct(F.concat(F.lit("/work/"), "path").alias("file_path"), F.col("text").alias("content"))
    rows = derived_lines(spark, sf_dir).select(F.to_json(F.struct(F.lit("Write").alias("tool_name"), F.lit("/work").alias("cwd"), given.alias("tool_input"))).alias("payload"))
    return Engine(spark).decide(rows)


@query()
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents and derived lines, all stages, by rule, severity, verdict and suppression."""
    docs = units_of_table(table(spark, sf_dir, "documents"), "doc_id", "text", F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    own = derived_lines(spark, sf_dir)
    more = own.select(F.concat(F.lit("part/"), F.col("k").cast("string")).alias("unit_id"), "path", "text", F.array("number").alias("numbers"))
    rows = Engine(spark).scan(docs.unionByName(more)).all()
    return rows.groupBy("rule_id", "severity", F.col("verdict.status").alias("status"), "suppressed").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))
