"""File churn: one row per (repo, path) from touches, by way of one row per (repo, path, author)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .history import reference_dates

DAY_MS = 86_400_000


def _ms(ts: str):
    return F.unix_millis(F.col(ts).cast("timestamp"))


def file_author(touches: DataFrame, half_life_days: float = 365.0, recent_days: float = 90.0, commits: DataFrame | None = None) -> DataFrame:
    """Additive measures per (repo, path, author). Spreads hot paths over their authors.

    The reference dates, one row per repo, are joined by key; a broadcast is left to the optimizer's size check.
    """
    dated = touches.join(reference_dates(touches if commits is None else commits), "repo", "left")
    lag = _ms("ref_ts") - _ms("author_ts")
    age = F.when(lag < 0, F.lit(0)).otherwise(lag)
    seen = F.struct("author_ts", "walk_seq")
    last = F.struct("author_ts", -F.col("walk_seq"))
    known = F.col("author_ts").isNotNull()
    return dated.groupBy("repo", "path", "author").agg(
        F.count(F.lit(1)).alias("commits"), F.count_if("is_bugfix").alias("bugfix_commits"), F.sum("added").alias("lines_added"), F.sum("deleted").alias("lines_deleted"),
        F.sum(F.coalesce(F.pow(F.lit(0.5), age / F.lit(half_life_days * DAY_MS)), F.lit(0.0))).alias("recency_weight"), F.count_if(age <= F.lit(int(recent_days * DAY_MS))).alias("recent_commits"),
        F.min(F.when(known, F.struct(seen.alias("k"), F.col("author_date").alias("d")))).alias("first"), F.max(F.when(known, F.struct(last.alias("k"), F.col("author_date").alias("d")))).alias("last"),
    )


def file_churn(authors: DataFrame, minor_threshold: float = 0.05, arrays: bool = False) -> DataFrame:
    """The churn record of each file, with ownership and bug-fix density, from file_author().

    Authors are compared with their file's total by a window over the file's authors and counted in the aggregate after it, one
    exchange for both; lists of authors are made only for records that are to be saved (arrays).
    """
    named = F.coalesce("author", F.lit("")) != ""
    file = W.partitionBy("repo", "path")
    whole = F.sum("commits").over(file)
    of = F.when(whole > 0, whole).otherwise(F.coalesce(F.sum(F.when(named, F.col("commits"))).over(file), F.lit(0)))
    own = authors.withColumns({"_named": named, "_of": of})
    minor = F.col("_named") & (F.col("_of") > 0) & (F.col("commits") / F.nullif(F.col("_of"), F.lit(0)) < minor_threshold)
    total = lambda c: F.sum(c).alias(c)
    lists = [F.array_sort(F.collect_list(F.when(F.col("_named"), F.struct(F.col("author").alias("name"), "commits")))).alias("author_commits")] if arrays else []
    f = own.groupBy("repo", "path").agg(
        *map(total, ("commits", "bugfix_commits", "lines_added", "lines_deleted", "recency_weight", "recent_commits")), *lists,
        F.min("first").alias("_first"), F.max("last").alias("_last"), F.count_if("_named").alias("n_authors"), F.count_if(minor).alias("minor_contributors"),
        F.coalesce(F.max(F.when(F.col("_named"), F.col("commits"))), F.lit(0)).alias("_most"), F.max("_of").alias("_of"),
    )
    f = f.withColumns({"first_seen": F.coalesce("_first.d", F.lit("")), "last_seen": F.coalesce("_last.d", F.lit("")), "first_ts": F.col("_first.k.author_ts"), "last_ts": F.col("_last.k.author_ts")})
    if arrays:
        f = f.withColumn("authors", F.transform("author_commits", lambda a: a["name"]))
    return _shares(f).drop("_first", "_last", "_most", "_of")


def _shares(f: DataFrame) -> DataFrame:
    """bugfix_density, top_share and fragmentation; all 0 without commits or authors."""
    top = F.when((F.col("_most") > 0) & (F.col("_of") > 0), F.col("_most") / F.nullif(F.col("_of"), F.lit(0))).otherwise(F.lit(0.0))
    density = F.when(F.col("commits") > 0, F.col("bugfix_commits") / F.nullif(F.col("commits"), F.lit(0))).otherwise(F.lit(0.0))
    return f.withColumns({"bugfix_density": density, "top_share": top, "fragmentation": F.when(top > 0, F.lit(1.0) - top).otherwise(F.lit(0.0))})


def with_ownership(saved: DataFrame, minor_threshold: float = 0.05) -> DataFrame:
    """Saved churn records with what file_churn() derives, from their lists of authors."""
    sizes = F.transform("author_commits", lambda a: F.coalesce(a["commits"], F.lit(0)))
    named = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    f = saved.withColumns({"n_authors": F.size("author_commits").cast("long"), "_most": F.coalesce(F.array_max(sizes), F.lit(0)), "_of": F.when(F.col("commits") > 0, F.col("commits")).otherwise(named)})
    minor = F.size(F.filter(sizes, lambda n: n / F.nullif(F.col("_of"), F.lit(0)) < minor_threshold))
    return _shares(f.withColumn("minor_contributors", minor.cast("long"))).drop("_most", "_of")
