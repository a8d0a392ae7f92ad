"""What follows detection: collapsing, baselines, requests, the offline judge, partitions and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve.functions.paths import is_doc_file, is_key_material, is_non_prod, is_test_path
from credsieve.functions.secrets import cache_key, redact, redact_in
from credsieve.functions.text import contains_any, matches, quoted, whole
from credsieve.plans import values as V
from credsieve.plans.catalog import RANKS

SHORTEST_RUN, WIDEST_GAP = 3, 2
HIGH_ENTROPY = 0.85


def first_of_fingerprint(found: DataFrame, unit: str = "unit_id", order: str = "ord") -> DataFrame:
    """The first finding of each fingerprint of a unit."""
    first = F.row_number().over(Window.partitionBy(unit, "fingerprint").orderBy(order))
    return found.withColumn("__k", first).where("__k = 1").drop("__k")


def collapsed(found: DataFrame) -> DataFrame:
    """Runs of a rule's findings on near lines of key material become their first, with their number.

    One shuffle, by file: windows by file, rule and run all find their rows together then.
    """
    armored = matches(F.col("line_text"), V.ARMOR) | matches(F.col("context"), V.ARMOR)
    armored = F.max(armored).over(Window.partitionBy("file"))
    order = Window.partitionBy("file", "rule_id").orderBy("line", "ord")
    gap = F.coalesce((F.col("line") - F.lag("line").over(order) > WIDEST_GAP).cast("int"), F.lit(1))
    rows = found.withColumn("__armored", armored).withColumn("__gap", gap)
    rows = rows.withColumn("__run", F.sum("__gap").over(order))
    run = Window.partitionBy("file", "rule_id", "__run")
    rows = rows.withColumns(
        {"__n": F.count(F.lit(1)).over(run), "__k": F.row_number().over(run.orderBy("line", "ord"))}
    )
    merged = (F.col("__n") >= SHORTEST_RUN) & (is_key_material(F.col("file")) | F.col("__armored"))
    rows = rows.withColumn("occurrences", F.when(merged, F.col("__n").cast("int")).otherwise(F.lit(1)))
    return rows.where(~merged | (F.col("__k") == 1)).select(*found.columns)


def with_known(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """`found` with known: the baseline holds its fingerprint.  One left join, so the scan behind `found` runs once;
    the optimizer broadcasts the baseline if its size allows."""
    names = baseline.select("fingerprint").distinct().withColumn("known", F.lit(True))
    return found.join(names, "fingerprint", "left").select(*found.columns, F.coalesce("known", F.lit(False)).alias("known"))


def split_by_baseline(found: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, known) by fingerprint, for findings that are stored; others are better flagged by with_known."""
    names = baseline.select("fingerprint").distinct()
    return found.join(names, "fingerprint", "left_anti"), found.join(names, "fingerprint", "left_semi")


def centred(context: Column, lines: int, line: Column) -> Column:
    """At most `lines` lines of a context, around the line the finding is on."""
    if lines <= 0:
        return context
    parts = F.split(context, "\n")
    starts = F.transform(parts, lambda x: x.startswith(F.concat(line.cast("string"), F.lit(": "))))
    at = F.array_position(starts, True).cast("int")
    low = F.greatest(F.lit(0), F.least(at - 1 - lines // 2, F.size(parts) - lines))
    low = F.when(at == 0, 0).otherwise(low)
    return F.when(F.size(parts) <= lines, context).otherwise(F.array_join(F.slice(parts, low + 1, F.lit(lines)), "\n"))


def requests(found: DataFrame, batch: int = 8, lines: int = 3, send_secret: bool = True) -> DataFrame:
    """What a judge is asked about each finding, with its cache key (of raw values, whatever is sent)."""
    raw = centred(F.col("context"), lines, F.col("line"))
    more = F.greatest("occurrences", F.lit(1))
    block = F.when((F.col("occurrences") > 1) | is_key_material(F.col("file")), "key_block").otherwise("single_line")
    made = found.withColumns(
        {
            "raw_context": raw,
            "is_test_path": is_test_path(F.col("file")),
            "block_type": block,
            "occurrences": more,
            "cache_key": cache_key(F.col("rule_id"), F.col("file"), F.col("secret"), raw, F.col("related"), F.col("decoded"), more),
        }
    )
    if send_secret:
        made = made.withColumn("context", F.col("raw_context"))
    else:
        made = made.withColumns(
            {
                "context": redact_in(F.col("raw_context"), F.col("secret")),
                "related": redact_in(F.col("related"), F.col("secret")),
                "decoded": redact(F.col("decoded")),
                "secret": redact(F.col("secret")),
            }
        )
    return made.drop("raw_context")


def batched(rows: DataFrame, batch: int, order: str = "cache_key") -> DataFrame:
    """Batch number and place within it, in the order of the key, within ranges of it: no single task numbers all rows."""
    ranged = rows.withColumn("__range", F.substring(order, 1, 2))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    ranged = ranged.withColumn("__place", place)
    return ranged.select(
        *rows.columns,
        F.concat_ws("-", "__range", F.floor(F.col("__place") / batch).cast("string")).alias("batch_id"),
        (F.col("__place") % batch).cast("int").alias("index"),
    )


def matched_line(context: Column, line: Column) -> Column:
    prefix = F.concat(line.cast("string"), F.lit(": "))
    found = F.get(F.filter(F.split(context, "\n"), lambda x: x.startswith(prefix)), F.lit(0))
    return F.coalesce(F.substr(found, F.length(prefix) + 1), F.lit(""))


def is_quoted(line: Column, secret: Column) -> Column:
    """The value stands in an open string of the line (or can't be found there)."""
    before = F.call_function("substring_index", line, secret, F.lit(1))
    odd = F.lit(False)
    for quote in "\"'`":
        odd = odd | (F.regexp_count(before, F.lit(rf"(?<!\\){quote}")) % 2 == 1)
    return (line == "") | (secret == "") | ~F.contains(line, secret) | odd


def suppressors(generic: Column) -> list[tuple[Column, str]]:
    """Shapes of the value or its line that say that it is no credential, with the reason; the first one counts."""
    secret, line = F.col("secret"), matched_line(F.col("context"), F.col("line"))
    low = F.lower(secret)
    user, password = (F.lower(F.regexp_extract(secret, V.URI_CREDENTIALS, k)) for k in (1, 2))
    code = matches(secret, V.CODE_EXPRESSION) | matches(secret, V.DOTTED_CALL) | matches(secret, V.SNAKE_NAME)
    marked = F.concat(F.lit("+"), secret, F.lit("+"))
    there = line != ""
    empty_words = whole(V.PLACEHOLDER_CREDENTIALS)
    return [
        (low.rlike(empty_words), "placeholder credential"),
        (low.rlike(whole(V.KNOWN_DIGESTS)), "published digest"),
        (user.rlike(empty_words) & password.rlike(empty_words), "placeholder credentials in a URI"),
        (F.contains(secret, F.lit("#{")) | F.contains(secret, F.lit("${")), "interpolation"),
        (secret.startswith("--"), "command-line flag"),
        (generic & there & matches(line, V.COMMENT), "comment line"),
        (generic & is_doc_file(F.col("file")), "documentation file"),
        (generic & matches(secret, V.BIG_INTEGER), "decimal integer"),
        (generic & there & matches(secret, V.MARKUP_NAME) & matches(marked, V.MARKUP) & F.contains(line, marked), "inline markup"),
        (generic & there & matches(line, V.METHOD_DEFINITION), "method definition"),
        (generic & there & ~is_quoted(line, secret) & code, "code expression"),
        (generic & (matches(secret, V.DOTTED_CALL) | matches(secret, V.SNAKE_NAME) | matches(secret, V.SYMBOL)), "identifier"),
    ]


def ladder() -> list[tuple[Column, str, float, str]]:
    """The rungs of the deterministic judge over a request's columns: (condition, status, confidence, reason)."""
    secret = F.col("secret")
    generic = (F.col("rule_id") == "") | F.col("rule_id").startswith("generic")
    words = F.lower("context").rlike(rf"(?<![0-9a-z_])(?:{'|'.join(V.CODE_CONTEXT_MARKERS)})(?![0-9a-z_])")
    known = secret.rlike(f"^(?:{quoted(V.KNOWN_PREFIXES)})")
    high = F.col("entropy") >= HIGH_ENTROPY
    return [
        (secret == "", "uncertain", 0.3, "no value"),
        (contains_any(F.lower(secret), V.PLACEHOLDER_MARKERS), "false_positive", 0.9, "placeholder marker"),
        *((shape, "false_positive", 0.85, reason) for shape, reason in suppressors(generic)),
        (matches(secret, V.UUID), "false_positive", 0.85, "UUID"),
        (generic & secret.rlike(r"^[0-9a-fA-F]{40}\z"), "false_positive", 0.7, "looks like a commit"),
        (generic & (is_non_prod(F.col("file")) | words), "false_positive", 0.75, "test, example or documentation"),
        (~generic & known, "secret", 0.95, "specific rule, known prefix"),
        (~generic & high, "secret", 0.9, "specific rule, high entropy"),
        (~generic, "secret", 0.7, "specific rule"),
        (high, "uncertain", 0.5, "high entropy, needs review"),
        (F.lit(True), "uncertain", 0.4, "can't decide offline"),
    ]


def with_offline_verdict(asked: DataFrame, name: str = "offline") -> DataFrame:
    """`asked` with the verdict of the first rung that holds.  The number of the rung is a column of its own, so its
    conditions are in the plan once, whatever of the verdict is read."""
    rungs = ladder()
    first = F.lit(None).cast("int")
    for k in range(len(rungs), 0, -1):
        first = F.when(rungs[k - 1][0], k).otherwise(first)
    status, confidence, reason = (F.element_at(F.array(*(F.lit(x[k]) for x in rungs)), F.col("__rung")) for k in (1, 2, 3))
    verdict = F.struct(status.alias("status"), confidence.alias("confidence"), reason.alias("reason"), F.lit(name).alias("verifier"))
    return asked.withColumn("__rung", first).withColumn("verdict", verdict).drop("__rung")


def is_provider_credential() -> Column:
    """A vendor's key at high severity or above, without a placeholder marker."""
    issued = (F.size("tags") > 0) & ~F.arrays_overlap("tags", F.array(*map(F.lit, V.UNISSUED_TAGS)))
    return issued & (F.col("rank") >= RANKS["high"]) & ~contains_any(F.lower("secret"), V.PLACEHOLDER_MARKERS)


def partitioned(judged: DataFrame, filtering: bool = True, least: float = 0.6) -> DataFrame:
    """`judged` (with verdict) with suppressed; a provider's key under a test path is kept as uncertain."""
    wrong = (F.col("verdict.status") == "false_positive") & (F.col("verdict.confidence") >= least) & F.lit(filtering)
    guarded = wrong & is_provider_credential() & is_test_path(F.col("file"))
    kept = F.col("verdict").withField("status", F.lit("uncertain"))
    kept = kept.withField("reason", F.lit("kept: a provider's key under a test path"))
    return judged.withColumns({"suppressed": wrong & ~guarded, "verdict": F.when(guarded, kept).otherwise(F.col("verdict"))})


def at_least(found: DataFrame, severity: str) -> DataFrame:
    return found.where(F.col("rank") >= RANKS[severity])
