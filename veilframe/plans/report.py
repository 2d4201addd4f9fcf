"""Summaries over recorded measurements and plan records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.median import exact_median

# Names in the records.
SYSTEMS = ("raw", "view", "static", "dynamic")
WORKLOAD_PATTERN = "_(point_lookup|range|groupby|distinct|topk)"

PLAN_SCHEMA = (
    "`Plan` struct<`Actual Total Time` double, `Plan Rows` bigint, `Actual Rows` bigint>, "
    "`Execution Time` double, `Shared Hit Blocks` bigint, `Shared Read Blocks` bigint"
)


def workload_label(experiment: Column) -> Column:
    """Workload named in an experiment's name, NULL if none is."""
    return F.nullif(F.regexp_extract(experiment, WORKLOAD_PATTERN, 1), F.lit(""))


def measurement_summary(
    runs: DataFrame,
    keys: Sequence[str] = ("experiment", "system", "query_idx"),
    run: str = "run",
    wall: str = "wall_clock_ms",
    rows: str = "row_count",
) -> DataFrame:
    """Runs, median, mean and deviation of the latency, and the first run's row count."""
    keys = list(keys)
    basics = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg(wall).alias("wall_clock_mean_ms"),
        F.coalesce(F.stddev_samp(wall), F.lit(0.0)).alias("wall_clock_std_ms"),
        F.min_by(rows, run).alias("row_count"),
    )
    medians = exact_median(runs, keys, wall, "wall_clock_median_ms")
    named = medians.select(*[F.col(k).alias(f"_m_{k}") for k in keys], "wall_clock_median_ms")
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
    return basics.join(named, condition, "left").select(
        *keys,
        "runs",
        "wall_clock_median_ms",
        "wall_clock_mean_ms",
        "wall_clock_std_ms",
        "row_count",
    )


def latency_pivot(
    summary: DataFrame,
    measure: str = "wall_clock_median_ms",
    systems: Sequence[str] = SYSTEMS,
) -> DataFrame:
    """Mean latency by workload, one column per system in fixed order."""
    labelled = summary.withColumn("workload", workload_label(F.col("experiment")))
    return (
        labelled.where(F.col("workload").isNotNull())
        .groupBy("workload")
        .pivot("system", list(systems))
        .agg(F.avg(measure))
    )


def overhead_pivot(
    summary: DataFrame,
    measure: str = "wall_clock_median_ms",
    systems: Sequence[str] = SYSTEMS,
    baseline: str = "raw",
) -> DataFrame:
    """Overhead in percent over the baseline system, by workload, rounded to one digit."""
    pivoted = latency_pivot(summary, measure, systems)
    base = F.col(baseline)
    return pivoted.select(
        "workload",
        *[
            F.round(F.try_divide(F.col(s) - base, base) * 100, 1).alias(s)
            for s in systems
            if s != baseline
        ],
    )


def plan_metrics(records: DataFrame, plan: str = "explain_plan") -> DataFrame:
    """Recorded plans as rows: time, estimated and actual rows, estimate error, buffers."""
    parsed = records.where(F.col(plan).isNotNull()).withColumn(
        "_p", F.from_json(F.col(plan), PLAN_SCHEMA)
    )
    zero = F.lit(0).cast("bigint")
    estimated = F.coalesce(F.col("_p.Plan.`Plan Rows`"), zero)
    actual = F.coalesce(F.col("_p.Plan.`Actual Rows`"), zero)
    error = F.when(actual > 0, F.abs(estimated - actual) / actual).otherwise(F.lit(0.0))
    return parsed.select(
        "experiment",
        "system",
        "query_idx",
        F.coalesce(
            F.col("_p.Plan.`Actual Total Time`"), F.col("_p.`Execution Time`"), F.lit(0.0)
        ).alias("actual_time_ms"),
        estimated.alias("estimated_rows"),
        actual.alias("actual_rows"),
        error.alias("row_estimate_error"),
        (
            F.coalesce(F.col("_p.`Shared Hit Blocks`"), zero)
            + F.coalesce(F.col("_p.`Shared Read Blocks`"), zero)
        ).alias("buffer_blocks"),
    )


def plan_summary(metrics: DataFrame) -> DataFrame:
    """Mean estimate error and buffers per system, rounded to two digits."""
    return metrics.groupBy("system").agg(
        F.round(F.avg("row_estimate_error"), 2).alias("row_estimate_error"),
        F.round(F.avg("buffer_blocks"), 2).alias("buffer_blocks"),
    )


def privacy_utility(metrics: DataFrame) -> DataFrame:
    """(query, epsilon, relative_error in percent) of noisy-aggregate records."""
    return metrics.select(
        "query", "epsilon", (F.col("relative_error") * F.lit(100.0)).alias("relative_error")
    )
