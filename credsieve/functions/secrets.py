"""Column expressions over secrets: masks, stable names and decoded forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.plans import values as V


def redact(secret: Column) -> Column:
    """A mask of fixed width; up to four characters stay at either end of a long value."""
    n = F.octet_length(secret)
    return (
        F.when(n == 0, "")
        .when(n < 8, "****")
        .when(n < 16, F.concat(F.substring(secret, 1, 2), F.lit("****")))
        .otherwise(F.concat(F.substring(secret, 1, 4), F.lit("****"), F.right(secret, F.lit(4))))
    )


def redact_in(text: Column, secret: Column) -> Column:
    return F.when(F.length(secret) == 0, text).otherwise(F.replace(text, secret, redact(secret)))


def fingerprint(rule: Column, path: Column, secret: Column) -> Column:
    """32 hex digits of rule, path and the secret's digest: the same wherever the line moves."""
    whole = F.concat(
        F.encode(rule, "UTF-8"), F.unhex(F.lit("00")), F.encode(path, "UTF-8"), F.unhex(F.lit("00")), F.unhex(F.sha2(secret, 256))
    )
    return F.substring(F.sha2(whole, 256), 1, 32)


def cache_key(rule: Column, path: Column, secret: Column, context: Column, related: Column, decoded: Column, occurrences: Column) -> Column:
    """A digest of length-prefixed fields; line numbers in the context don't count."""
    plain = F.regexp_replace(context, r"(?m)^[0-9]+: ", "")
    parts = []
    for field in (rule, path, secret, plain, related, decoded, occurrences.cast("string")):
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(field).cast("long")), 16, "0")), F.encode(field, "UTF-8")]
    return F.sha2(F.concat(*parts), 256)


def printable(data: Column) -> Column:
    """Bytes as text if they read as text: valid UTF-8, no control characters, half of it letters or digits; else null."""
    text = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))
    letters = F.regexp_count(text, F.lit(r"[\p{L}\p{Nd}]"))
    odd = text.rlike(r"[^\p{L}\p{M}\p{N}\p{P}\p{S} \n\r\t]")
    return F.when((F.octet_length(text) >= 6) & ~odd & (letters * 2 >= F.char_length(text)), text)


def decode_base64(text: Column) -> Column:
    """Either alphabet, not both; padding is optional; null unless the result is printable."""
    raw = F.regexp_replace(text, "=+$", "")
    ok = (F.length(raw) % 4 != 1) & ~(raw.rlike("[-_]") & raw.rlike("[+/]")) & raw.rlike("^[A-Za-z0-9+/_-]+$")
    full = F.translate(F.rpad(raw, F.ceil(F.length(raw) / 4).cast("int") * 4, "="), "-_", "+/")
    return printable(F.try_to_binary(F.when(ok, full), F.lit("base64")))


def decode_hex(text: Column) -> Column:
    n = F.length(text)
    return printable(F.when((n >= 16) & (n % 2 == 0) & text.rlike("^[0-9A-Fa-f]+$"), F.unhex(text)))


def decode_percent(line: Column) -> Column:
    decoded = F.try_url_decode(F.replace(line, F.lit("+"), F.lit("%2B")))
    text = printable(F.encode(decoded, "UTF-8"))
    return F.when((F.regexp_count(line, F.lit("%")) >= 2) & (text != line), text)


def decode_unicode_escapes(line: Column) -> Column:
    """Each escape of four hex digits becomes its character."""
    parts = F.regexp_extract_all(line, F.lit(r"(?s)\\u[0-9a-fA-F]{4}|."), F.lit(0))
    whole = F.array_join(
        F.transform(
            parts,
            lambda x: F.when(x.rlike(r"^\\u[0-9a-fA-F]{4}$"), F.decode(F.unhex(F.substring(x, 3, 4)), "UTF-16BE")).otherwise(x),
        ),
        "",
    )
    text = printable(F.encode(whole, "UTF-8"))
    return F.when(F.contains(line, F.lit("\\u")) & (text != line), text)


def value_decoded(value: Column) -> Column:
    """What a located value decodes to, named by its encoding and clipped, or an empty string."""

    def clipped(text: Column) -> Column:
        return F.when(F.octet_length(text) > V.DECODED_BYTES, F.concat(F.substring(text, 1, V.DECODED_BYTES), F.lit("…"))).otherwise(text)

    found = F.coalesce(
        F.concat(F.lit("base64: "), clipped(decode_base64(value))), F.concat(F.lit("hex: "), clipped(decode_hex(value)))
    )
    return F.when(F.octet_length(value) < 8, "").otherwise(F.coalesce(found, F.lit("")))
