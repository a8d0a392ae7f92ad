"""Column expressions over the UTF-8 bytes of a string: entropy, charset classes, runs and placeholders."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.plans import values as V
from credsieve.plans.catalog import for_jvm


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def quoted(words: Iterable[str]) -> str:
    """A pattern for any of the words, literally."""
    return "|".join(rf"\Q{w}\E" for w in words)


def whole(words: Iterable[str]) -> str:
    """A pattern for texts that are one of the words."""
    return rf"^(?:{quoted(words)})\z"


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """One pattern for all words: for short texts, where a plan of many `contains` costs more than it saves."""
    words = tuple(words)
    return text.rlike(quoted(words)) if words else F.lit(False)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(for_jvm(pattern))


def byte_codes(text: Column) -> Column:
    """The bytes as hex pairs."""
    return F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))


def renyi_entropy(text: Column, alpha: float = 2.0) -> Column:
    """Entropy of order alpha in bits; of order 1 it is Shannon's; 0 for fewer than two bytes or alpha <= 0."""
    if alpha <= 0:
        return F.lit(0.0)

    def of(codes: Column) -> Column:
        n = F.size(codes).cast("double")
        share = lambda b: F.size(F.filter(codes, lambda x: x == b)) / n
        kinds = F.array_distinct(codes)
        if abs(alpha - 1) < 1e-9:
            total = F.aggregate(kinds, F.lit(0.0), lambda acc, b: acc - share(b) * F.log2(share(b)))
        else:
            total = F.log2(F.aggregate(kinds, F.lit(0.0), lambda acc, b: acc + F.pow(share(b), F.lit(alpha)))) / (1 - alpha)
        return F.when(F.size(codes) < 2, 0.0).otherwise(total)

    return let(byte_codes(text), of)


def charset_class(text: Column) -> Column:
    """The smallest of ten classes that holds the text."""
    low, up, digit = (text.rlike(x) for x in ("[a-z]", "[A-Z]", "[0-9]"))
    return (
        F.when(text.rlike("[^0-9A-Za-z+/=_-]"), "printable")
        .when(text.rlike("[+/=_-]"), "base64")
        .when(digit & ~low & ~up, "digits")
        .when(digit & low & ~up & ~text.rlike("[g-z]"), "hex")
        .when(digit & up & ~low & ~text.rlike("[G-Z]"), "hex")
        .when(low & up & digit, "alphanum")
        .when(low & up, "alpha")
        .when(low & digit, "lowernum")
        .when(up & digit, "uppernum")
        .when(low, "lower")
        .otherwise("upper")
    )


def charset_size(name: Column) -> Column:
    sizes = F.create_map(*(F.lit(x) for pair in V.CHARSET_SIZES.items() for x in pair))
    return sizes[name]


def expected_collision(n: Column, k: Column) -> Column:
    """Expected order-2 entropy of n symbols drawn evenly from k."""
    n, k = n.cast("double"), k.cast("double")
    return F.when((n < 2) | (k < 2), 0.0).otherwise(-F.log2(1 / n + (n - 1) / (n * k)))


def normalized_score(text: Column) -> Column:
    """Order-2 entropy over what is expected of its class, 0 to 1.25."""
    n = F.octet_length(text)
    expected = expected_collision(n, charset_size(charset_class(text)))
    score = F.least(F.lit(1.25), F.greatest(F.lit(0.0), renyi_entropy(text) / expected))
    return F.when((n < 2) | (expected <= 0), 0.0).otherwise(score)


def distinct_bytes(text: Column) -> Column:
    return F.size(F.array_distinct(byte_codes(text)))


def longest_step_run(text: Column) -> Column:
    """The longest run of bytes that each follow, or each precede, the one before by one."""

    def of(codes: Column) -> Column:
        start = F.struct(F.lit(-9).alias("last"), F.lit(1).alias("up"), F.lit(1).alias("down"), F.lit(0).alias("best"))

        def step(acc: Column, b: Column) -> Column:
            code = F.conv(b, 16, 10).cast("int")
            up = F.when(code == acc["last"] + 1, acc["up"] + 1).otherwise(1)
            down = F.when(code == acc["last"] - 1, acc["down"] + 1).otherwise(1)
            best = F.when(acc["last"] < 0, acc["best"]).otherwise(F.greatest(acc["best"], up, down))
            return F.struct(code.alias("last"), up.alias("up"), down.alias("down"), best.alias("best"))

        return F.aggregate(codes, start, step)["best"]

    return let(byte_codes(text), of)


def is_placeholder(text: Column, more: Iterable[str] = ()) -> Column:
    """A stop word, a repeated byte, a counting run, or too few different bytes for the length."""
    least = F.least(F.lit(12), F.greatest(F.lit(5), F.floor(F.octet_length(text) / 5).cast("int")))
    return (
        contains_any(F.lower(text), [*V.STOPWORDS, *(x.lower() for x in more)])
        | text.rlike(r"(?s)(.)\1{4}")
        | (longest_step_run(text) >= 6)
        | (distinct_bytes(text) < least)
    )


def has_digit_or_symbol(text: Column) -> Column:
    return text.rlike("[0-9][^0-9]*[0-9]") | text.rlike("[+=]")


def secret_shaped(text: Column) -> Column:
    """Mixed classes, marks, or long and random enough; prose is not."""
    up, low, digit = (text.rlike(x) for x in (r"\p{Lu}", r"\p{Ll}", r"\p{Nd}"))
    marks = text.rlike(r"[^\p{Lu}\p{Ll}\p{Nd} _\-.:/]")
    spaces = F.regexp_count(text, F.lit(" "))
    letters = F.regexp_count(text, F.lit(r"[\p{Lu}\p{Ll}]"))
    n = F.octet_length(text)
    prose = (spaces >= 2) & (letters + spaces >= 0.85 * n)
    shaped = (up & low & digit) | marks | (digit & (n >= 16) & (normalized_score(text) >= 0.8))
    return (n >= 12) & ~F.contains(text, F.lit("://")) & ~prose & shaped


def skip_reason(secret: Column, line: Column) -> Column:
    """Why a token of the entropy sweep is no candidate, or null."""
    low = F.lower(line)
    hexadecimal = matches(secret, V.HEX)
    return (
        F.when(matches(secret, V.UUID), "uuid")
        .when(~has_digit_or_symbol(secret), "no-digit")
        .when(hexadecimal & (F.length(secret) == 40) & contains_any(low, V.GIT_SHA_CONTEXT), "git-sha")
        .when(hexadecimal & F.length(secret).isin(64, 128) & contains_any(low, V.DIGEST_CONTEXT), "digest")
        .when(is_placeholder(secret), "placeholder")
    )
