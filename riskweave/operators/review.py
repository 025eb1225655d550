"""Change review: working sets against a ranking, and files that usually change with theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY = ["change_id", "repo", "path"]


def all_changes(*sets: DataFrame) -> DataFrame:
    """Distinct paths of several lists (staged and not), the paths of an earlier list before those of a later one: pos is the
    first list's number times 2^32 plus the place there."""
    out = sets[0].select(*KEY, F.col("pos").cast("long").alias("pos"))
    for i, s in enumerate(sets[1:], 1):
        out = out.unionByName(s.select(*KEY, (F.col("pos") + F.lit(i << 32)).alias("pos")))
    return out.groupBy(*KEY).agg(F.min("pos").alias("pos"))


def working_set(changes: DataFrame) -> DataFrame:
    """One spelling of each path, the first by pos, whatever its case."""
    first = F.min_by("path", F.struct("pos", "path"))
    return changes.groupBy("change_id", "repo", F.lower("path").alias("lower_path")).agg(first.alias("path"), F.min("pos").alias("pos"))


def with_score(changed: DataFrame, risk: DataFrame) -> DataFrame:
    """Changed files that have a score, riskiest first in each change set."""
    hit = changed.select(*KEY).join(risk.select("repo", "path", "score", "tier"), ["repo", "path"])
    return hit.withColumn("place", F.row_number().over(W.partitionBy("change_id").orderBy(F.desc("score"), "path")))


def without_history(changed: DataFrame, risk: DataFrame) -> DataFrame:
    return changed.select(*KEY).join(risk.select("repo", "path"), ["repo", "path"], "left_anti")


def hints(changed: DataFrame, partners: DataFrame, floor: float = 0.3) -> DataFrame:
    """The first partner of each changed file, where it is strong enough and not itself changed (in any case)."""
    best = partners.where(F.col("partner_rank") == 1).where(F.col("strength") >= floor).select("repo", "path", "partner", "strength", "shared_commits")
    found = changed.select(*KEY).join(best, ["repo", "path"]).withColumn("_low", F.lower("partner"))
    present = changed.select("change_id", "repo", F.lower("path").alias("_low"))
    return found.join(present, ["change_id", "repo", "_low"], "left_anti").drop("_low")
