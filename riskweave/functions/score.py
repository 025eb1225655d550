"""Score columns: risk, tier and trend."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import SIGNALS


def additive_core(norm: dict[str, Column], weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for s in SIGNALS:
        total = total + norm[s] * F.lit(float(weights[s]))
    return total


def risk_score(core: Column, complexity: Column, density: Column) -> Column:
    raw = core * (F.lit(0.5) + F.lit(0.5) * complexity) * (F.lit(1.0) + density)
    return F.round(F.lit(100.0) * F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))).cast("int")


def tier(score: Column, thresholds: dict[str, float]) -> Column:
    low = F.when(score < thresholds["medium"], "low").when(score < thresholds["high"], "medium")
    return low.when(score < thresholds["critical"], "high").otherwise("critical")


def trend(commits: Column, recent: Column) -> Column:
    share = recent / F.nullif(commits, F.lit(0))
    return F.when(commits <= 0, "stable").when((share >= 0.5) & (commits >= 3), "rising").when(share <= 0.1, "cooling").otherwise("stable")
