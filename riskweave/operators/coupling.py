"""Change coupling: pairs of files that change in the same commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.paths import is_excluded
from .numbering import join_weighed


def commit_paths(touches: DataFrame, max_files: int = 50) -> DataFrame:
    """Distinct (repo, walk_seq, path) of commits with 2 to max_files files. Touches are read once, and one exchange serves all
    steps; a very large commit is counted by a window, which spills, before any set of it is made."""
    d = touches.select("repo", "walk_seq", "path").repartition("repo", "walk_seq").distinct()
    counted = d.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("repo", "walk_seq")))
    return counted.where(F.col("_n").between(2, max_files)).drop("_n")


def co_change(touches: DataFrame, max_files: int = 50, exclude=()) -> DataFrame:
    """(repo, path_a, path_b, shared_commits), path_a < path_b. Excluded paths go after the size limit and before pairing."""
    paths = commit_paths(touches, max_files).where(~is_excluded(F.col("path"), exclude))
    sets = paths.groupBy("repo", "walk_seq").agg(F.sort_array(F.collect_list("path")).alias("p"))
    ahead = lambda a, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda b: F.struct(a.alias("path_a"), b.alias("path_b")))
    pairs = sets.select("repo", F.explode(F.flatten(F.transform("p", ahead))).alias("e"))
    return pairs.groupBy("repo", F.col("e.path_a").alias("path_a"), F.col("e.path_b").alias("path_b")).agg(F.count(F.lit(1)).alias("shared_commits"))


def strengths(pairs: DataFrame, churn: DataFrame, min_support: int = 5) -> DataFrame:
    """Both directions of each supported pair: (repo, path, partner, strength, shared_commits).

    A path in very many pairs has very many commits: those with over a thousandth of all are broadcast, fewer than a thousand.
    Eager: the commits of churn are summed up, so let churn be a stored table.
    """
    total = churn.agg(F.sum("commits")).first()[0] or 0
    revs = lambda s: churn.select("repo", F.col("path").alias(f"path_{s}"), F.col("commits").alias(f"revs_{s}"))
    p = pairs.where(F.col("shared_commits") >= min_support)
    for end, other in ("ab", "ba"):
        p = join_weighed(p, revs(end), ["repo", f"path_{end}"], f"revs_{end}", total, f"path_{other}")
    most = F.greatest(F.coalesce("revs_a", F.lit(0)), F.coalesce("revs_b", F.lit(0)))
    p = p.withColumn("_most", most).where("_most > 0").withColumn("strength", F.col("shared_commits") / F.col("_most"))
    way = lambda a, b: F.struct(F.col(a).alias("path"), F.col(b).alias("partner"))
    both = p.select("repo", F.explode(F.array(way("path_a", "path_b"), way("path_b", "path_a"))).alias("e"), "strength", "shared_commits")
    return both.select("repo", "e.path", "e.partner", "strength", "shared_commits")


def partners(links: DataFrame, top_k: int = 5) -> DataFrame:
    """The top_k partners of each file with their rank."""
    w = W.partitionBy("repo", "path").orderBy(F.desc("strength"), F.desc("shared_commits"), "partner")
    return links.withColumn("partner_rank", F.row_number().over(w)).where(F.col("partner_rank") <= top_k)


def coupling_signal(links: DataFrame) -> DataFrame:
    return links.groupBy("repo", "path").agg(F.max("strength").alias("coupling"))
