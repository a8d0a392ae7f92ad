"""Column expressions over names of values: how they split into words, and what they say about the value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.functions.text import contains_any, let, matches, secret_shaped, whole
from credsieve.plans import values as V

NONE, IDENTITY, WEAK, SECRET, PASSWORD = range(5)


def key_words(key: Column) -> Column:
    """Lower-cased words of a snake, kebab, dotted or camel-case name."""
    apart = F.regexp_replace(key, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    words = F.regexp_extract_all(apart, F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))
    return F.transform(words, F.lower)


def _one_of(word: Column, words: tuple[str, ...]) -> Column:
    return word.rlike(whole(words))


def _is_password(word: Column) -> Column:
    return (
        _one_of(word, ("pass", "pwd"))
        | F.contains(word, F.lit("passw"))
        | word.rlike("^pass(?:phrase|code)")
        | (word.endswith("pass") & ~_one_of(word, V.PASS_WORDS))
        | word.endswith("pwd")
    )


def _is_secret(word: Column, before: Column) -> Column:
    return (
        contains_any(word, ("secret", "credential", "apikey"))
        | _one_of(word, ("tokens", "creds"))
        | word.endswith("token")
        | ((word == "key") & F.coalesce(before == "api", F.lit(False)))
    )


def _is_weak(word: Column, before: Column) -> Column:
    qualified = word.rlike(f"^(?:{'|'.join(V.KEY_QUALIFIERS)}).*key$") & (F.length(word) > 3)
    return ((word == "key") & F.coalesce(before != "public", F.lit(False))) | word.endswith("salt") | (word == "auth") | qualified


def _is_identity(word: Column) -> Column:
    return _one_of(word, V.IDENTITY_WORDS) | word.rlike("(?:user|username|host)$") | (word == "hostname")


def classify_key(key: Column) -> Column:
    """0 none, 1 identity, 2 weak, 3 secret, 4 password."""

    def of(words: Column) -> Column:
        last = F.element_at(words, -1)
        n = F.size(words)

        def rank(word: Column, k: Column) -> Column:
            before = F.get(words, k - 1)
            return (
                F.when(_is_password(word), PASSWORD)
                .when(_is_secret(word, before), SECRET)
                .when(_is_weak(word, before), WEAK)
                .when((k == n - 1) & _is_identity(word), IDENTITY)
                .otherwise(NONE)
            )

        best = F.array_max(F.transform(words, rank))
        return (
            F.when(n == 0, NONE)
            .when((n > 1) & _one_of(last, V.META_SUFFIXES), NONE)
            .when((n == 1) & (last == "pass") & (F.upper(key) == key), NONE)
            .when((best == WEAK) & (last == "id"), IDENTITY)
            .otherwise(best)
        )

    return F.coalesce(let(key_words(key), of), F.lit(NONE))


def classify_assigned_key(key: Column) -> Column:
    """The class of the last part of a dotted or namespaced key."""
    return classify_key(F.regexp_replace(key, r"^.*[.:](?=[^.:]+$)", ""))


def anchored_placeholder(value: Column) -> Column:
    """The whole value (digits at its end aside) is a stop word, or begins with one that asks for more."""
    low = F.lower(value)
    open_ended = [w for w in V.STOPWORDS if w.endswith(("_", "-")) or w.startswith("<")]
    found = low.rlike(whole(V.STOPWORDS)) | F.regexp_replace(low, "[0-9]+$", "").rlike(whole(V.STOPWORDS))
    for word in open_ended:
        found = found | low.startswith(word)
    return found


def is_literal(value: Column, quoted: Column) -> Column:
    """A value rather than a reference, template, type, path or placeholder."""
    n = F.octet_length(value)
    low, high = V.VALUE_BYTES
    return (
        n.between(low, high)
        & ~matches(value, V.TEMPLATE)
        & ~matches(value, V.VARIABLE)
        & ~matches(value, V.PATH)
        & ~value.rlike(r"^(?:\$\{|\{\{|#\{)")
        & (quoted | ~(value.rlike(r"^[(\[{]") | F.contains(value, F.lit("("))))
        & (F.regexp_count(value, F.lit(" ")) < 4)
        & ~F.contains(value, F.lit("\\n"))
        & ~F.lower(value).rlike(whole(V.NON_VALUES))
        & ~value.rlike(r"(?s)^(.)\1*\z")
        & ~anchored_placeholder(value)
    )


def identifier_like(value: Column) -> Column:
    """Few, long words of letters: a symbol or a composite key."""
    letters = F.regexp_count(value, F.lit(r"\p{L}"))
    n = F.octet_length(value)
    words = F.size(key_words(value))
    return ~value.rlike(r"[^\p{L}\p{Nd}_\-.:/]") & (words <= 6) & (letters * 10 >= n * 6) & (n >= 3 * words)


def is_candidate(value: Column, key_class: Column, quoted: Column) -> Column:
    """Whether a value assigned to a key of this class is a candidate."""
    shaped = secret_shaped(value) & ~identifier_like(value)
    return (key_class >= WEAK) & is_literal(value, quoted) & ((key_class > WEAK) | shaped)
