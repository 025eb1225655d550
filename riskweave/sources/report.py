"""Markdown reports as (repo, line_no, line) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cell, percent, trend_label, why_cell
from ..params import SIGNALS

# The report's title, note and column heads.
TITLE = "# Hotspot Risk Report"
NOTE = ', ranked by risk (relative within this repo — not a literal "% buggy").'
HEADS = "| # | File | Score | Tier | Trend | Commits | Churn | Authors | Ownership | Coupling | Complexity |"
RULE = "| - | ---- | ----: | ---- | ----- | ------: | ----: | ------: | --------: | -------: | ---------: |"


def markdown(report: DataFrame, explain: bool = True) -> DataFrame:
    """One row per line, by repo and line_no; rows of ranked files start at line 7. The first file brings the head, the last
    one the closing blank line, and the number of files is the last rank, one row for each repo."""
    text = lambda c: F.col(c).cast("string")
    cells = [text("rank"), cell(F.col("path")), text("score"), F.col("tier"), trend_label(F.col("trend")), text("freq"), text("churn"), text("authors"), *(F.concat(percent(F.col(c)).cast("string"), F.lit("%")) for c in ("ownership", "coupling")), F.col("complexity").cast("bigint").cast("string")]
    if explain:
        own = F.coalesce(*(F.when(F.col("dominant") == s, F.col(f"shares.{s}")) for s in SIGNALS))
        cells.append(cell(why_cell(F.col("dominant"), own)))
    counted = report.join(report.groupBy("repo").agg(F.max("rank").alias("_n")), "repo")
    n = F.col("_n")
    note = F.concat(n.cast("string"), F.when(n == 1, " scored file").otherwise(" scored files"), F.lit(NOTE))
    head = [F.lit(TITLE), F.lit(""), note, F.lit(""), F.lit(HEADS + (" Why |" if explain else "")), F.lit(RULE + (" ---- |" if explain else ""))]
    line = lambda no, what: F.struct(no.cast("int").alias("line_no"), what.alias("line"))
    none = F.array().cast("array<struct<line_no:int,line:string>>")
    own_line = F.array(line(F.col("rank") + 6, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))))
    first = F.when(F.col("rank") == 1, F.array(*(line(F.lit(i + 1), h) for i, h in enumerate(head)))).otherwise(none)
    last = F.when(F.col("rank") == n, F.array(line(n + 7, F.lit("")))).otherwise(none)
    return counted.select("repo", F.explode(F.concat(first, own_line, last)).alias("_l")).select("repo", "_l.*")


def write_markdown(lines: DataFrame, path: str) -> None:
    """One folder per repo, lines in order."""
    lines.repartitionByRange("repo", "line_no").sortWithinPartitions("repo", "line_no").select("repo", "line").write.mode("overwrite").partitionBy("repo").text(path)
