"""Text columns of explanations, hints and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import CAVEAT, PHRASES, SIGNALS, TIER_BADGES, TREND_ARROWS, TREND_LABELS


def percent(share: Column) -> Column:
    return F.round(share * 100).cast("int")


def looked_up(key: Column, names: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[key]


def trend_label(trend: Column) -> Column:
    return looked_up(trend, TREND_LABELS)


def trend_arrow(trend: Column) -> Column:
    return looked_up(trend, TREND_ARROWS)


def tier_badge(tier: Column) -> Column:
    return F.coalesce(looked_up(tier, TIER_BADGES), F.lit(""))


def ranked_shares(shares: dict[str, Column]) -> Column:
    """array<struct<minus, place, signal>>, the largest share first, in the signals' order among equals."""
    return F.array_sort(F.array(*(F.struct((-shares[s]).alias("minus"), F.lit(i).alias("place"), F.lit(s).alias("signal")) for i, s in enumerate(SIGNALS))))


def breakdown(ranked: Column) -> Column:
    return F.array_join(F.transform(ranked, lambda r: F.concat(r["signal"], F.lit(" "), percent(-r["minus"]).cast("string"), F.lit("%"))), " · ")


def sentence(ranked: Column, dominant: Column, partner: Column) -> Column:
    def phrase(r):
        own = F.concat(F.lit("is coupled to "), partner)
        named = F.when((r["signal"] == "coupling") & (F.coalesce(partner, F.lit("")) != ""), own).otherwise(looked_up(r["signal"], PHRASES))
        return F.concat(named, F.lit(" ("), percent(-r["minus"]).cast("string"), F.lit("%)"))

    top = F.slice(F.filter(ranked, lambda r: r["minus"] < 0), 1, 2)
    because = F.concat(F.lit("Mostly because it "), F.array_join(F.transform(top, phrase), " and "), F.lit(f". {CAVEAT}"))
    return F.when(dominant.isNull(), f"Not enough history to attribute this score. {CAVEAT}").otherwise(because)


# The wording of activity, signals, partners and hints.
def activity(freq: Column, authors: Column, ownership: Column, coupling: Column, churn: Column) -> Column:
    by = F.concat(F.lit("Changed "), freq.cast("string"), F.lit("× by "), authors.cast("string"), F.when(authors == 1, " author").otherwise(" authors"))
    owned = F.when(ownership >= 0.6, "fragmented ownership").when(ownership >= 0.3, "shared ownership")
    coupled = F.when(coupling >= 0.6, "strongly coupled to other files").when(coupling >= 0.3, "coupled to other files")
    return F.concat_ws(" · ", by, owned, coupled, F.when(churn > 0, F.concat(churn.cast("string"), F.lit(" lines churned"))))


def signal_line(freq: Column, churn: Column, authors: Column, ownership: Column, coupling: Column, complexity: Column) -> Column:
    return F.format_string("commits %d · churn %d · authors %d · ownership %d%% fragmented · coupling %d%% · complexity %d", freq, churn, authors, percent(ownership), percent(coupling), complexity)


def partner_label(strength: Column, partner: Column) -> Column:
    return F.concat(percent(strength).cast("string"), F.lit("% · "), partner)


def hint_text(changed: Column, strength: Column, shared: Column) -> Column:
    return F.concat(F.lit("usually changes with "), changed, F.format_string(" (%d%%, %d×) — not in your working set", percent(strength), shared))


def cell(text: Column) -> Column:
    """A value for a table cell: pipes escaped."""
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def why_cell(dominant: Column, share: Column) -> Column:
    return F.coalesce(F.concat(dominant, F.lit(" "), percent(share).cast("string"), F.lit("%")), F.lit("—"))
