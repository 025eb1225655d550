"""Commits and touches: log dumps, walk order, windows, limits and reference dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.commits import is_bugfix, line_count
from ..functions.paths import resolve_rename
from .numbering import numbered


def parse_log(dumps: DataFrame, text: str = "value", segment: str | None = None) -> DataFrame:
    """Touches from log dumps (repo, text[, segment]): one row per file line, walk_seq counting commits from 1.

    Dumps of a large repo come in segments; walk_seq is then the segment's number times 2^32 plus the place in it.
    """
    base = F.col(segment).cast("long") * F.lit(1 << 32) if segment else F.lit(0).cast("long")
    chunks = dumps.select("repo", base.alias("_base"), F.posexplode(F.split(text, "\n(?=[^\n]*\\x00)")).alias("_pos", "_chunk"))
    lines = F.split("_chunk", "\n")
    head = F.split(F.element_at(lines, 1), "\\x00")
    known = chunks.where(F.element_at(lines, 1).contains("\0"))
    commits = known.select("repo", (F.col("_base") + F.col("_pos") + 1).alias("walk_seq"), *_fields(head), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))).alias("_rows"))
    return _touches(commits.select("*", F.posexplode("_rows").alias("row_no", "_row")).where(F.col("_row").rlike("\t[^\t]*\t")))


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """parse_log() for dumps of any size, from lines (repo, segment, block, at, value): a segment's blocks come in order, and `at`
    orders the lines of a block, which is what one task has read.

    Commits and lines are counted within each block and shifted by the counts of the segment's earlier blocks, from which a
    block also takes the commit that its first lines belong to.
    """
    block, is_head = ["repo", "segment", "block"], F.contains("value", F.lit("\0"))
    here = W.partitionBy(*block).orderBy("at")
    up_to = here.rowsBetween(W.unboundedPreceding, 0)
    placed = lines.select(*block, "at", "value", is_head.alias("_is_head")).withColumn("_line", F.row_number().over(here).cast("long"))
    placed = placed.withColumns({"_heads": F.count_if("_is_head").over(up_to), "_last": F.last(F.when(F.col("_is_head"), F.struct(F.col("value").alias("head"), F.col("_line").alias("line"))), ignorenulls=True).over(up_to)})
    ends = placed.groupBy(*block).agg(F.max("_line").alias("_n"), F.max("_heads").alias("_h"), F.max_by("_last", "_line").alias("_end"))
    earlier = W.partitionBy("repo", "segment").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_lines_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    at_end = F.when(F.col("_end").isNotNull(), F.struct(F.col("_end.head").alias("head"), (F.col("_end.line") + F.col("_lines_before")).alias("line")))
    ends = ends.select(*block, "_lines_before", F.coalesce(F.sum("_h").over(earlier), F.lit(0)).alias("_heads_before"), F.last(at_end, ignorenulls=True).over(earlier).alias("_before"))
    whole = placed.where("NOT _is_head").join(ends, block)
    own = F.when(F.col("_last").isNotNull(), F.struct(F.col("_last.head").alias("head"), (F.col("_last.line") + F.col("_lines_before")).alias("line")))
    whole = whole.withColumn("_commit", F.coalesce(own, "_before")).where(F.col("_commit").isNotNull() & F.col("value").rlike("\t[^\t]*\t"))
    head = F.split("_commit.head", "\\x00")
    seq = F.col("segment").cast("long") * F.lit(1 << 32) + F.col("_heads_before") + F.col("_heads")
    row_no = (F.col("_lines_before") + F.col("_line") - F.col("_commit.line") - 1).cast("int")
    return _touches(whole.select("repo", seq.alias("walk_seq"), row_no.alias("row_no"), *_fields(head), F.col("value").alias("_row")))


def _fields(head: Column) -> list[Column]:
    field = lambda i: F.coalesce(F.get(head, F.lit(i)), F.lit(""))
    return [field(0).alias("sha"), field(1).alias("author"), field(2).alias("author_date"), F.regexp_replace(field(3), "\r$", "").alias("subject")]


def _touches(rows: DataFrame) -> DataFrame:
    """Touches of file lines (_row) with their commit's fields."""
    part = F.split("_row", "\t", 3)
    path = resolve_rename(F.regexp_replace(part[2], "\r$", ""))
    out = rows.select("repo", "walk_seq", "row_no", "sha", "author", "author_date", F.try_to_timestamp("author_date").alias("author_ts"), "subject", is_bugfix(F.col("subject")).alias("is_bugfix"), path.alias("path"), line_count(part[0]).alias("added"), line_count(part[1]).alias("deleted"))
    return out.where("path <> ''")


def with_walk_order(commits: DataFrame) -> DataFrame:
    """commits with walk_seq, the newest first, where the source has no walk order of its own. Eager, see numbered()."""
    return numbered(commits, ["repo"], [F.col("author_ts").desc_nulls_last(), F.col("sha").desc()], "walk_seq")


def heads(commits: DataFrame) -> DataFrame:
    """(repo, head_sha): the first commit of each repo's walk."""
    return commits.groupBy("repo").agg(F.min_by(F.col("sha").cast("string"), "walk_seq").alias("head_sha"))


def since(commits: DataFrame, months: int, as_of: Column) -> DataFrame:
    """Commits of the last `months` months before as_of, to the time of day, by the commit's own time (commit_ts) where there is
    one; 0 keeps all, undated ones too."""
    at = F.col("commit_ts" if "commit_ts" in commits.columns else "author_ts")
    return commits.where(at >= as_of - F.make_interval(months=F.lit(months))) if months > 0 else commits


def without_merges(commits: DataFrame) -> DataFrame:
    return commits.where(~F.coalesce("is_merge", F.lit(False)))


def newest(commits: DataFrame, n: int) -> DataFrame:
    """The first n commits of each repo's walk."""
    w = W.partitionBy("repo").orderBy("walk_seq")
    return commits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def touches_of(touches: DataFrame, commits: DataFrame) -> DataFrame:
    return touches.join(commits.select("repo", "walk_seq"), ["repo", "walk_seq"], "left_semi")


def reference_dates(commits: DataFrame) -> DataFrame:
    """(repo, ref_ts): the first dated commit in walk order."""
    return commits.where("author_ts IS NOT NULL").groupBy("repo").agg(F.min_by("author_ts", "walk_seq").alias("ref_ts"))
