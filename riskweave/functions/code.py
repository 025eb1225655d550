"""Code columns: indentation, region score, severity, reasons and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import SEVERITIES

# Where depth and length factors are full, and their weights.
FULL_DEPTH, FULL_LINES, DEPTH_WEIGHT, LINES_WEIGHT = 10, 60, 0.7, 0.3
CUTS = (25, 50, 75)
DEEP, LONG = 5, 20


def indent(line: Column, spaces: int = 4) -> Column:
    """Levels of indentation: tabs, and spaces in groups; -1 for a blank line. One trailing carriage return is cut."""
    spaces = spaces if spaces > 0 else 4
    code = F.regexp_replace(line, "\r$", "")
    lead = F.regexp_extract(code, "^[ \t]*", 0)
    tabs = F.length(F.replace(lead, F.lit(" "), F.lit("")))
    levels = F.floor((F.length(lead) - tabs) / F.lit(spaces)).cast("int") + tabs
    return F.when(F.length(lead) == F.length(code), F.lit(-1)).otherwise(levels)


def region_score(depth: Column, lines: Column) -> Column:
    full = lambda v, cap: F.least(F.lit(1.0), v / F.lit(float(cap)))
    return F.round(F.lit(100.0) * (F.lit(DEPTH_WEIGHT) * full(depth, FULL_DEPTH) + F.lit(LINES_WEIGHT) * full(lines, FULL_LINES))).cast("int")


def region_severity(score: Column) -> Column:
    return F.when(score < CUTS[0], "low").when(score < CUTS[1], "medium").when(score < CUTS[2], "high").otherwise("critical")


def region_reasons(depth: Column, lines: Column) -> Column:
    word = F.when(depth >= DEEP, "deeply nested").otherwise("nested")
    return F.array_compact(F.array(F.format_string("%s (depth %d)", word, depth), F.when(lines >= LONG, F.format_string("long block (%d lines)", lines))))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


# The wording of labels and hovers.
def region_label(severity: Column, depth: Column, lines: Column) -> Column:
    return F.format_string("⚠ Risk: %s · depth %d · %d lines", severity, depth, lines)


def region_hover(severity: Column, reasons: Column) -> Column:
    return F.concat(F.lit("🔥 **Risky code ("), severity, F.lit(")** — "), F.concat_ws(", ", reasons), F.lit(".\n\n_Change this region carefully._"))
