"""Gapless numbers within groups of any size, and joins with hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import stored

HOT = 1000


def numbered(df: DataFrame, group: list[str], order: list[Column | str], out: str, kind: str = "bigint") -> DataFrame:
    """df with numbers from 1 within each group, by `order`; no task holds a whole group.

    Rows are dealt to ranges of (group, order) and sorted there; a group's rows in a range are numbered from the range's first,
    and shifted by what the group has in earlier ranges: one row for each group and range. Eager: the sorted rows are a stored
    table, which drop_stored() of the result deletes.
    """
    placed = stored(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = placed.withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select(*(F.col(g).alias(f"_g_{g}") for g in group), F.col("_part").alias("_p"), (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    on = F.col("_part") == F.col("_p")
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    numbers = rows.join(runs, on).select(*df.columns, (F.col("_at") + F.col("_shift")).cast(kind).alias(out))
    numbers.stored_at = placed.stored_at
    return numbers


def join_weighed(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, spread: str) -> DataFrame:
    """left with the columns of its unique partner in right, null where there is none (a left join).

    Keys of right that weigh over a HOT-th of `total`, the sum of all weights, are hot: fewer than HOT, so they are broadcast.
    All others meet by key; rows of left that are done are spread by the column `spread`, as no key of theirs is left.
    """
    cols, last = [c for c in right.columns if c not in on], on[-1]
    hot = F.coalesce(F.col(weight), F.lit(0)) * HOT > total
    first = right.where(hot).select(*on, F.struct(*cols).alias("_hot"))
    rest = right.where(~hot).select(*on[:-1], F.col(last).alias("_k"), F.struct(*cols).alias("_cold"))
    marked = left.join(F.broadcast(first), on, "left")
    marked = marked.withColumn("_k", F.when(F.col("_hot").isNull(), F.col(last)).otherwise(F.concat(F.lit("\0"), spread)))
    both = marked.join(rest, [*on[:-1], "_k"], "left")
    return both.select(*left.columns, *(F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in cols))
