"""Path columns: renames, keys, globs, names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve_rename(path: Column) -> Column:
    """The new name of a renamed path as the log writes it."""
    braced = r"\{[^{}]* => ([^{}]*)\}"
    inner = F.regexp_replace(F.regexp_replace(path, braced, "$1"), "/{2,}", "/")
    plain = F.when(path.contains("{"), path).otherwise(F.substring_index(path, " => ", -1))
    return F.regexp_replace(F.when(path.rlike(braced), inner).otherwise(plain), r"^\s+|\s+$", "")


def repo_key(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def glob_regex(patterns) -> str | None:
    """One anchored pattern for a list of globs; None if there is none."""
    meaning = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    each = ["".join(meaning.get(t, re.escape(t)) for t in re.split(r"(\*\*/|\*\*|\*|\?)", p)) for p in patterns if p]
    return f"^(?:{'|'.join(each)})$" if each else None


def is_excluded(path: Column, patterns) -> Column:
    rx = glob_regex(patterns)
    return repo_key(path).rlike(rx) if rx else F.lit(False)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def first_match(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda rest, p: F.when(p[0], p[1]).otherwise(rest), reversed(pairs), otherwise)
