"""Folder rollup of a ranking as parent and child rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.paths import segments


def folder_tree(risk: DataFrame, order: str | None = None) -> DataFrame:
    """(repo, path, parent_path, name, depth, is_file, area, score, tier, sibling_rank); the root is ''.

    Duplicate paths: the last by `order` (else the largest score) wins. Folders of one name with a file stay separate.
    """
    clean = risk.withColumn("_s", segments(F.col("path"))).where(F.size("_s") > 0)
    last = F.max_by(F.struct("_s", "churn", "score", "tier"), F.col(order) if order else F.struct("score", "path"))
    leaf = clean.groupBy("repo", F.array_join("_s", "/").alias("_p")).agg(last.alias("l")).select("repo", "l.*")
    leaf = leaf.withColumn("area", F.greatest(F.col("churn").cast("double"), F.lit(1.0)))
    nodes = leaf.select("repo", "area", "score", "tier", F.col("_s"), F.explode(F.sequence(F.lit(0), F.size("_s"))).alias("depth"))
    nodes = nodes.withColumns({"path": F.array_join(F.slice("_s", 1, F.col("depth")), "/"), "is_file": F.col("depth") == F.size("_s")})
    g = nodes.groupBy("repo", "path", "depth", "is_file").agg(F.sum("area").alias("area"), F.max(F.struct("score", "tier")).alias("t"))
    parent = F.when(F.col("depth") > 0, F.regexp_replace("path", "/?[^/]*$", ""))
    g = g.select("repo", "path", parent.alias("parent_path"), F.element_at(F.split("path", "/"), -1).alias("name"), "depth", "is_file", "area", "t.score", "t.tier")
    w = W.partitionBy("repo", "parent_path").orderBy(F.desc("area"), "name", "is_file")
    return g.withColumn("sibling_rank", F.row_number().over(w))
