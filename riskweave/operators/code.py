"""Source contents: indentation complexity and risky regions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.code import indent, region_reasons, region_score, region_severity, severity_rank


def complexity(files: DataFrame, spaces: int = 4) -> DataFrame:
    """(repo, path, total, mean, max, lines) over non-blank lines; in-row, no line becomes a row."""
    depth = F.filter(F.transform(F.split("content", "\n"), lambda x: indent(x, spaces)), lambda d: d >= 0)
    c = files.select("repo", "path", depth.alias("_d"))
    n, total = F.size("_d").cast("long"), F.aggregate("_d", F.lit(0).cast("long"), lambda a, x: a + x)
    mean = F.when(n > 0, total / n).otherwise(F.lit(0.0))
    return c.select("repo", "path", total.alias("total"), mean.alias("mean"), F.coalesce(F.array_max("_d"), F.lit(0)).alias("max"), n.alias("lines"))


def _finished(raw: DataFrame) -> DataFrame:
    """Score, severity, reasons and rank of regions (repo, path, start_line, end_line, max_depth)."""
    r = raw.withColumn("line_count", F.col("end_line") - F.col("start_line") + 1)
    r = r.withColumn("score", region_score(F.col("max_depth"), F.col("line_count")))
    r = r.withColumns({"severity": region_severity(F.col("score")), "reasons": region_reasons(F.col("max_depth"), F.col("line_count"))})
    return r.withColumn("region_rank", F.row_number().over(W.partitionBy("repo", "path").orderBy(F.desc("score"), "start_line")))


RAW = "repo string, path string, start_line int, end_line int, max_depth int"


def regions(files: DataFrame, spaces: int = 4, min_depth: int = 3, min_lines: int = 3) -> DataFrame:
    """Runs of deep lines of each file: indentation in-row, runs by array operations over all lines of a batch at once; only
    regions leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            d, ends = lists.flatten().to_numpy(), np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())
            file = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            deep = np.flatnonzero(d >= min_depth)
            island = np.cumsum((d >= 0) & (d < min_depth))[deep]  # files break runs as shallow lines do
            first = np.flatnonzero(np.r_[True, (island[1:] != island[:-1]) | (file[deep][1:] != file[deep][:-1])]) if len(deep) else deep
            start, end = deep[first], deep[np.r_[first[1:], len(deep)] - 1] if len(deep) else deep
            most = np.maximum.reduceat(d[deep], first) if len(deep) else d[deep]
            kept = end - start + 1 >= min_lines
            of = file[start[kept]]
            begin = (ends - np.diff(ends, prepend=0))[of]
            numbers = [pa.array(x.astype(np.int32)) for x in (start[kept] - begin, end[kept] - begin, most[kept])]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of)), *numbers], names=["repo", "path", "start_line", "end_line", "max_depth"])

    depths = files.select("repo", "path", F.transform(F.split("content", "\n"), lambda x: indent(x, spaces)).alias("depth"))
    return _finished(depths.mapInArrow(run, RAW))


def regions_by_window(files: DataFrame, spaces: int = 4, min_depth: int = 3, min_lines: int = 3) -> DataFrame:
    """The same regions in built-in functions, with every line as a row: the cross-check of regions()."""
    lines = files.select("repo", "path", F.posexplode(F.split("content", "\n")).alias("line", "_text")).withColumn("depth", indent(F.col("_text"), spaces))
    shallow = F.col("depth").between(0, min_depth - 1).cast("int")
    lines = lines.withColumn("_gid", F.sum(shallow).over(W.partitionBy("repo", "path").orderBy("line").rowsBetween(W.unboundedPreceding, 0)))
    runs = lines.where(F.col("depth") >= min_depth).groupBy("repo", "path", "_gid").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.max("depth").alias("max_depth"))
    return _finished(runs.drop("_gid").where(F.col("end_line") - F.col("start_line") + 1 >= min_lines))


def at_least(found: DataFrame, severity: str = "medium") -> DataFrame:
    return found.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(severity)))


def by_severity(found: DataFrame) -> DataFrame:
    """The line ranges of each (repo, path, severity), best region first."""
    ranges = F.transform(F.array_sort(F.collect_list(F.struct("region_rank", "start_line", "end_line"))), lambda r: F.struct(r["start_line"].alias("start_line"), r["end_line"].alias("end_line")))
    return found.groupBy("repo", "path", "severity").agg(ranges.alias("ranges"))


def at_position(positions: DataFrame, found: DataFrame, severity: str = "medium") -> DataFrame:
    """positions (repo, path, line, ...) that fall in a region at or over a severity, each with the best such region; repeats stay.

    The regions of a file are one array, sorted by line, which meets the file's positions in a join by file; each position finds
    its region by binary search in its row. Regions that overlap, as those of other sources may, are searched best first.
    """
    one = F.struct("start_line", "end_line", "score", "severity", "reasons")
    kept = at_least(found, severity).groupBy("repo", "path").agg(F.array_sort(F.collect_list(one)).alias("_regions"))
    neighbours = F.zip_with(F.slice("_regions", 1, F.size("_regions") - 1), F.slice("_regions", 2, F.size("_regions")), lambda a, b: a["end_line"] >= b["start_line"])
    ranked = F.array_sort("_regions", lambda a, b: F.when((a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["start_line"] < b["start_line"])), -1).otherwise(1))
    kept = kept.withColumn("_ranked", F.when(F.exists(neighbours, lambda x: x), ranked))
    near = positions.join(kept, ["repo", "path"])
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    begun = lambda s: F.get("_regions", middle(s))["start_line"] <= F.col("line")
    narrowed = lambda s: F.struct(F.when(begun(s), middle(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(begun(s), s["hi"]).otherwise(middle(s)).alias("hi"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size("_regions") + F.lit(1.0))).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), F.size("_regions").alias("hi"))
    last = F.aggregate(steps, start, lambda s, _: F.when(s["lo"] < s["hi"], narrowed(s)).otherwise(s), lambda s: s["lo"] - 1)  # the last that begins at the line or before
    holds = lambda r: F.col("line").between(r["start_line"], r["end_line"])
    region = F.when(F.col("_ranked").isNotNull(), F.get(F.filter("_ranked", holds), F.lit(0))).otherwise(F.get("_regions", last))
    return near.withColumn("_region", region).where(holds(F.col("_region"))).select(*positions.columns, "_region.*")
