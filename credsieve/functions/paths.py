"""Column expressions over paths: globs, and what a place says about what is found there."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.functions.keys import SECRET, classify_key
from credsieve.functions.text import matches, whole
from credsieve.plans import values as V

_GLOB = re.compile(r"\*\*/|\*\*|\*|\?|[^*?]+")
_GLOB_PARTS = {"**/": "(?:[^/]*/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_pattern(glob: str) -> str:
    """A pattern for whole paths: without a slash the glob is for the last part, else for any whole-part ending."""
    body = "".join(_GLOB_PARTS.get(x) or re.sub(r"([.+()|\[\]{}^$\\])", r"\\\1", x) for x in _GLOB.findall(glob))
    return f"^(?:.*/)?{body}$"


def matches_globs(path: Column, globs: Iterable[str]) -> Column:
    whole = "|".join(f"(?:{glob_pattern(x)})" for x in globs)
    return F.regexp_replace(path, r"\\", "/").rlike(whole.replace("$)", r"\z)")) if whole else F.lit(False)


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]*)/*\z", 1)


def _extension(base: Column) -> Column:
    """Behind the last dot, unless that is the first character."""
    return F.regexp_extract(base, r"^.+\.([^.]*)\z", 1)


def needs_quotes(path: Column) -> Column:
    base = F.lower(base_name(path))
    return base.rlike(f"^(?:{'|'.join(V.PROSE_NAMES)})") | (base.rlike(r"^.+\.") & _extension(base).rlike(whole(V.QUOTED_EXTENSIONS)))


def is_credential_file(path: Column) -> Column:
    base = F.lower(base_name(path))
    dotted = base.rlike(r"^.+\.")
    stem = F.when(dotted, F.regexp_extract(base, r"^(.+)\.[^.]*\z", 1)).otherwise(base)
    return (~dotted | _extension(base).rlike(whole(V.DATA_EXTENSIONS))) & (classify_key(stem) >= SECRET)


def is_key_material(path: Column) -> Column:
    base = F.lower(base_name(path))
    return F.regexp_extract(base, r"\.([^.]*)\z", 1).rlike(whole(V.KEY_MATERIAL_EXTENSIONS)) | matches(base, V.KEY_MATERIAL_NAME)


def _folders(path: Column) -> Column:
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: ~x.isin("", "."))


def is_test_path(path: Column) -> Column:
    base = F.lower(base_name(path))
    folder = F.exists(_folders(path), lambda x: F.lower(x).rlike(whole(V.TEST_DIRECTORIES)) | matches(x, V.TEST_DIRECTORY_SHAPE))
    return folder | base.rlike(r"^(?:test|mock)|[_.]test\.|-test|test-|[._]spec\.")


def is_doc_file(path: Column) -> Column:
    base = F.lower(F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]*)\z", 1))
    return base.rlike(whole(V.DOC_NAMES)) | F.regexp_extract(base, r"\.([^.]*)\z", 1).rlike(whole(V.DOC_EXTENSIONS))


def is_non_prod(path: Column) -> Column:
    low = F.regexp_replace(F.lower(F.regexp_replace(path, r"\\", "/")), "^/+|/+$", "")
    base = F.regexp_extract(low, r"([^/]*)\z", 1)
    tokens = F.split(base, "[^a-z0-9]+")
    folder = F.exists(_folders(low), lambda x: x.rlike(whole(V.NON_PROD_DIRECTORIES)))
    return folder | is_doc_file(low) | F.exists(tokens, lambda x: x.rlike(whole(V.NON_PROD_TOKENS)))
