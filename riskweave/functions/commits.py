"""Commit columns: bug-fix subjects and line counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark bug fixes, issue closings and commits that are neither.
FIX_WORDS = r"bugfix(?:e[sd])?|fix(?:e[sd])?|bug|defect|fault|crash|hotfix|patch|regression|broke(?:n)?"
CLOSE_WORDS = r"close[sd]?|fix(?:e[sd])?|resolve[sd]?"
NOT_FIX_WORDS = r"merge|cherry[- ]pick|revert"

#: ASCII word borders: an accented letter doesn't continue a word.
LEFT, RIGHT = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


def is_bugfix(subject: Column) -> Column:
    has = lambda rx: subject.rlike(f"(?i){rx}")
    fix = has(f"{LEFT}(?:{FIX_WORDS}){RIGHT}") | has(f"{LEFT}(?:{CLOSE_WORDS})\\s+#[0-9]+")
    return F.coalesce(fix & ~has(f"{LEFT}(?:{NOT_FIX_WORDS}){RIGHT}"), F.lit(False))


def line_count(text: Column) -> Column:
    """A count as the log writes it; binary marks and other texts are 0."""
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))
