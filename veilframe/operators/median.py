"""Exact median per group without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.session import stored_once

# Ranges per unit of the logarithmic scale. All doubles lie within 710 units of
# zero, which bounds the ranges of a group, whatever its size.
RANGES_PER_UNIT = 1_024
# Ranges a group's remaining values are cut into by their own smallest and largest.
LINEAR_RANGES = 4_096
# Distinct values of a group that one task puts in order without another cut.
ORDERED_VALUES = 100_000
# Each cut leaves a few in LINEAR_RANGES of evenly spread values.
_REFINEMENTS = 4
_NAN_RANGE = 2**40


def exact_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str = "median",
    ranges_per_unit: int = RANGES_PER_UNIT,
    linear_ranges: int = LINEAR_RANGES,
    ordered_values: int = ORDERED_VALUES,
) -> DataFrame:
    """(keys, median) of the non-null values; NaN counts as larger than any number.

    Rows are reduced to the distinct values of each group, spread over all tasks by
    (group, value). A logarithmic grid, which long-tailed latencies fill evenly, tells
    which range holds the middle positions. Where that range holds many values, as a narrow
    band far from zero does (epoch seconds, for instance), they are cut again by an even grid
    between the group's smallest and largest of them. Only the values in the last range are
    put in order.
    """
    keys = list(keys)
    x = F.col("_x")
    values = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_below", F.lit(0).cast("bigint"))
        .withColumn("_n", F.lit(None).cast("bigint"))
    )
    by_size = F.floor(F.signum(x) * F.log1p(F.abs(x)) * F.lit(ranges_per_unit))
    # What is left is read several times, so it is written.
    values = values.withColumn("_range", _ranged(by_size))
    candidates = stored_once(middle_range(values, keys), "median-range")
    for _ in range(_REFINEMENTS):
        largest = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"))
        if (largest.first()[0] or 0) <= ordered_values:
            break
        number = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
        ends = candidates.groupBy(*keys).agg(F.min(number).alias("_low"), F.max(number).alias("_high"))
        placed = candidates.join(
            ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_low", "_high"),
            _null_safe(keys),
        ).drop(*[f"_k_{k}" for k in keys])
        # Halved, so that the width of the widest range does not overflow.
        share = F.try_divide(x / 2 - F.col("_low") / 2, F.col("_high") / 2 - F.col("_low") / 2)
        even = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), share)) * F.lit(linear_ranges))
        ranged = placed.withColumn("_range", _ranged(even))
        candidates = stored_once(middle_range(ranged, keys), "median-range")
    within = W.partitionBy(*keys).orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    ordered = candidates.withColumn("_upto", F.col("_below") + F.sum("_c").over(within))

    def at(position: Column) -> Column:
        here = (F.col("_upto") >= position) & (F.col("_upto") - F.col("_c") < position)
        return F.max(F.when(here, x))

    low, high = _middle()
    return ordered.groupBy(*keys).agg(((at(low) + at(high)) / F.lit(2.0)).alias(name))


def middle_range(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _x, _c, _below, _n) of the values in the ranges that hold the middle positions.

    `_below` is the number of a group's rows below all values given, `_n` that of all its
    rows, null at first.
    """
    group = W.partitionBy(*keys)
    earlier = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counted = (
        values.groupBy(*keys, "_range")
        .agg(
            F.sum("_c").alias("_rows"),
            F.min("_below").alias("_below"),
            F.min("_n").alias("_known"),
        )
        .withColumn(
            "_before", F.min("_below").over(group) + F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
        )
        .withColumn("_n", F.coalesce("_known", F.sum("_rows").over(group)))
    )
    low, high = _middle()
    middle = (
        counted.where((F.col("_before") < high) & (F.col("_before") + F.col("_rows") >= low))
        .withColumn("_first", F.min("_before").over(group))
        .select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.col("_range").alias("_k__range"),
            F.col("_first"),
            F.col("_n").alias("_all"),
        )
    )
    return values.join(middle, _null_safe([*keys, "_range"])).select(
        *keys, "_x", "_c", F.col("_first").alias("_below"), F.col("_all").alias("_n")
    )


def _ranged(number: Column) -> Column:
    """Range number of a value: NaN last, 0 where the grid has no width."""
    return F.when(F.isnan("_x"), F.lit(_NAN_RANGE)).otherwise(
        F.coalesce(F.nanvl(number.cast("double"), F.lit(0.0)).cast("bigint"), F.lit(0))
    )


def _middle() -> tuple[Column, Column]:
    """The two middle positions; the same one when the number of values is odd."""
    return F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1


def _null_safe(keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return condition
