"""Explanations: shares of the additive core, the dominant signal and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import first_match
from ..functions.text import breakdown, ranked_shares, sentence
from ..params import SIGNALS, WEIGHTS


def shares(risk: DataFrame, weights: dict | None = None) -> DataFrame:
    """Adds shares (struct of six), dominant and core_pct to normalised rows; the multipliers and the clamp play no part."""
    weights = weights or WEIGHTS
    part = {s: F.col(f"norm_{s}") * F.lit(float(weights[s])) for s in SIGNALS}
    total = sum((part[s] for s in SIGNALS), F.lit(0.0))
    df = risk.withColumn("_core", total)
    share = {s: F.when(F.col("_core") > 0, part[s] / F.col("_core")).otherwise(F.lit(0.0)) for s in SIGNALS}
    df = df.withColumn("shares", F.struct(*(share[s].alias(s) for s in SIGNALS)))
    most = F.greatest(*(F.col(f"shares.{s}") for s in SIGNALS))
    dominant = first_match([(F.col(f"shares.{s}") == most, F.lit(s)) for s in SIGNALS], F.lit(None).cast("string"))
    return df.withColumns({"dominant": F.when(F.col("_core") > 0, dominant), "core_pct": F.round(F.col("_core") * 100).cast("int")}).drop("_core")


def explained(risk: DataFrame, partners: DataFrame | None = None, weights: dict | None = None) -> DataFrame:
    """shares() with the breakdown line and the sentence, which names the first partner where coupling counts."""
    df = shares(risk, weights)
    if partners is None:
        df = df.withColumn("partner", F.lit(None).cast("string"))
    else:
        df = df.join(partners.where("partner_rank = 1").select("repo", "path", "partner"), ["repo", "path"], "left")
    df = df.withColumn("partner", F.when(F.col("shares.coupling") > 0, F.col("partner")))
    df = df.withColumn("_ranked", ranked_shares({s: F.col(f"shares.{s}") for s in SIGNALS}))
    return df.withColumns({"line": breakdown(F.col("_ranked")), "sentence": sentence(F.col("_ranked"), F.col("dominant"), F.col("partner"))}).drop("_ranked")
