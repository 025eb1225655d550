"""Risk: joined signals, per-repo normalisation, score, tier, trend, rank and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.paths import repo_key
from ..functions.score import additive_core, risk_score, tier, trend
from ..params import LOW_CONFIDENCE, SIGNALS, THRESHOLDS, WEIGHTS
from .numbering import numbered

RAW = (*SIGNALS, "complexity")


def signals(churn: DataFrame, complexity: DataFrame | None = None, coupling: DataFrame | None = None) -> DataFrame:
    """The raw signals of every file in churn; what is missing elsewhere is 0."""
    df = churn.select("repo", "path", F.col("commits").alias("freq"), (F.col("lines_added") + F.col("lines_deleted")).alias("churn"), F.col("recency_weight").alias("recency"), F.col("n_authors").alias("authors"), F.col("fragmentation").alias("ownership"), "bugfix_density", "commits", "recent_commits")
    for other, column, name in ((coupling, "coupling", "coupling"), (complexity, "total", "complexity")):
        if other is None:
            df = df.withColumn(name, F.lit(0.0))
        else:
            df = df.join(other.select("repo", "path", F.col(column).alias(name)), ["repo", "path"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return df


def normalised(df: DataFrame) -> DataFrame:
    """norm_<signal>: log1p, then min-max within the repo; 0 where all are equal. Bounds come from one aggregate per repo."""
    low = [F.min(F.log1p(s)).alias(f"_lo_{s}") for s in RAW]
    high = [F.max(F.log1p(s)).alias(f"_hi_{s}") for s in RAW]
    df = df.join(df.groupBy("repo").agg(*low, *high), "repo")
    unit = lambda s: F.when(F.col(f"_hi_{s}") > F.col(f"_lo_{s}"), (F.log1p(s) - F.col(f"_lo_{s}")) / (F.col(f"_hi_{s}") - F.col(f"_lo_{s}"))).otherwise(F.lit(0.0))
    return df.withColumns({f"norm_{s}": unit(s) for s in RAW}).drop(*(f"_{e}_{s}" for s in RAW for e in ("lo", "hi")))


def normalised_by_window(df: DataFrame, column: str) -> DataFrame:
    """The analytic form for small repos: norm_<column> of one column."""
    w, x = W.partitionBy("repo"), F.log1p(column)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return df.withColumn(f"norm_{column}", F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.0)))


def scored(norm: DataFrame, weights: dict | None = None, thresholds: dict | None = None) -> DataFrame:
    """Adds core, score, tier and trend."""
    core = additive_core({s: F.col(f"norm_{s}") for s in SIGNALS}, weights or WEIGHTS)
    df = norm.withColumn("core", core).withColumn("score", risk_score(F.col("core"), F.col("norm_complexity"), F.col("bugfix_density")))
    return df.withColumns({"tier": tier(F.col("score"), thresholds or THRESHOLDS), "trend": trend(F.col("commits"), F.col("recent_commits"))})


def ranked(risk: DataFrame) -> DataFrame:
    """Adds rank within the repo: score descending, path ascending. Eager, see numbered()."""
    return numbered(risk, ["repo"], [F.desc("score"), F.col("path")], "rank", "int")


def top(risk: DataFrame, n: int = 20) -> DataFrame:
    """The first n of each repo with their rank; each task keeps n of a repo before any exchange."""
    place = F.row_number().over(W.partitionBy("repo").orderBy(F.desc("score"), "path"))
    return risk.withColumn("rank", place).where(F.col("rank") <= max(1, n))


def in_order(risk: DataFrame) -> DataFrame:
    return risk.orderBy("repo", F.desc("score"), "path")


def lookup(keys: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of a (repo, path) table for keys whose paths may be written the editor's way."""
    return keys.withColumn("path", repo_key(F.col("path"))).join(table, ["repo", "path"])


def confidence(risk: DataFrame, files: int = 5, top_score: int = 15) -> DataFrame:
    """(repo, files, top_score, note): a note where a ranking rests on too little."""
    g = risk.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.max("score").alias("top_score"))
    return g.withColumn("note", F.when((F.col("files") < files) | (F.col("top_score") < top_score), LOW_CONFIDENCE))
