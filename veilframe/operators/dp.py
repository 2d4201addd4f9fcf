"""Noisy aggregates by the Laplace mechanism, and how accurate they are.

The sensitivities are stated, not enforced: unless `clip` is given, input values
may exceed them and the result is no privacy guarantee. Choosing the top groups
before adding noise is not covered by epsilon either.

The key is a secret and each release needs its own: two releases under one key carry
the same noise, which their difference cancels. Hence there is no default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import prf
from veilframe.functions.masks import bucket

EPSILONS = (0.1, 0.5, 1.0, 5.0)
# Stated sensitivities and query names.
MAX_GAIN = 100_000
MAX_HOURS = 100
COUNT_QUERY = "count_by_age"
AVG_QUERY = "avg_capital_gain_by_education"
SUM_QUERY = "sum_hours_by_occupation"


def _per_epsilon(aggregated: DataFrame, epsilons: Sequence[float]) -> DataFrame:
    """Repeat the aggregated rows (never the input) once per epsilon."""
    return aggregated.withColumn(
        "epsilon", F.explode(F.array(*[F.lit(float(e)) for e in epsilons]))
    )


def _noise(key: str, label: str, group: Column, sensitivity: float, share: float = 1.0) -> Column:
    """Laplace noise per group and epsilon, spending `share` of epsilon."""
    ident = F.concat(F.coalesce(group.cast("string"), F.lit("")), F.lit("|"), F.col("epsilon"))
    return prf.laplace(
        key, label, ident, F.lit(float(sensitivity)) / (F.col("epsilon") * F.lit(share))
    )


def _clipped(value: Column, clip: float | None) -> Column:
    if clip is None:
        return value
    # Null-aware: least() and greatest() alone would turn a NULL into the bound.
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(clip)), F.lit(-clip)))


def noisy_count(
    df: DataFrame,
    age: str = "age",
    width: int = 10,
    epsilons: Sequence[float] = EPSILONS,
    *,
    key: str,
) -> DataFrame:
    """Count per age bucket, noise of sensitivity 1, not below 0."""
    counts = df.groupBy(bucket(F.col(age), width).alias("age_bucket")).agg(
        F.count(F.lit(1)).alias("cnt")
    )
    noised = F.greatest(F.lit(0.0), F.col("cnt") + _noise(key, "count", F.col("age_bucket"), 1))
    return _per_epsilon(counts, epsilons).withColumn("cnt_noised", noised)


def noisy_avg(
    df: DataFrame,
    group: str = "education",
    measure: str = "capital_gain",
    sensitivity: float = MAX_GAIN,
    epsilons: Sequence[float] = EPSILONS,
    clip: float | None = None,
    *,
    key: str,
) -> DataFrame:
    """Average as noisy sum over noisy count (at least 1), half of epsilon each."""
    value = _clipped(F.col(measure), clip)
    groups = (
        df.where(F.col(group) != "?")
        .groupBy(group)
        .agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"), F.count(F.lit(1)).alias("cnt"))
        .withColumn("avg_gain", F.try_divide(F.col("_sum").cast("double"), F.col("_n")))
    )
    total = F.col("avg_gain") * F.col("cnt") + _noise(key, "sum", F.col(group), sensitivity, 0.5)
    rows = F.greatest(F.lit(1.0), F.col("cnt") + _noise(key, "rows", F.col(group), 1, 0.5))
    return (
        _per_epsilon(groups, epsilons)
        .withColumn("avg_gain_noised", total / rows)
        .drop("_sum", "_n")
    )


def noisy_sum(
    df: DataFrame,
    group: str = "occupation",
    measure: str = "hours_per_week",
    sensitivity: float = MAX_HOURS,
    top: int = 10,
    epsilons: Sequence[float] = EPSILONS,
    clip: float | None = None,
    *,
    key: str,
) -> DataFrame:
    """Sum over the `top` groups with the largest sums, not below 0."""
    groups = (
        df.where(F.col(group) != "?")
        .groupBy(group)
        .agg(F.sum(_clipped(F.col(measure), clip)).alias("total_hours"))
        .orderBy(F.col("total_hours").desc_nulls_first(), F.col(group))
        .limit(top)
    )
    noised = F.greatest(
        F.lit(0.0), F.col("total_hours") + _noise(key, "total", F.col(group), sensitivity)
    )
    return _per_epsilon(groups, epsilons).withColumn("total_hours_noised", noised)


def accuracy(
    released: DataFrame, query: str, true_value: str, noised: str, offset: float = 0.0
) -> DataFrame:
    """(query, epsilon, mae, relative_error); `offset` is added to the denominator."""
    gap = F.abs(F.col(true_value) - F.col(noised))
    return released.groupBy("epsilon").agg(
        F.lit(query).alias("query"),
        F.avg(gap).alias("mae"),
        F.avg(F.try_divide(gap, F.col(true_value) + F.lit(float(offset)))).alias("relative_error"),
    ).select("query", "epsilon", "mae", "relative_error")


def accuracy_sweep(
    df: DataFrame, epsilons: Sequence[float] = EPSILONS, *, key: str
) -> DataFrame:
    """Accuracy of the three studied queries for every epsilon."""
    return (
        accuracy(noisy_count(df, epsilons=epsilons, key=key), COUNT_QUERY, "cnt", "cnt_noised")
        .unionByName(
            accuracy(
                noisy_avg(df, epsilons=epsilons, key=key),
                AVG_QUERY, "avg_gain", "avg_gain_noised", offset=1.0,
            )
        )
        .unionByName(
            accuracy(
                noisy_sum(df, epsilons=epsilons, key=key),
                SUM_QUERY, "total_hours", "total_hours_noised",
            )
        )
    )
