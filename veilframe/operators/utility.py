"""How much of a column's information a mask keeps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, name: str) -> DataFrame:
    """(name, value, rows) of the non-null values."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(name).alias("name"), "value", "rows")
    )


def compare_distributions(
    original: DataFrame, masked: Mapping[str, DataFrame], column: str
) -> DataFrame:
    """(name, original_distinct, masked_distinct, cardinality_ratio, js_distance) per table.

    The original's value counts are repeated per masked table and put together with
    its counts by value, so a value missing on one side counts as 0 there. Both
    metrics come out of the same pass. The distance is the square root of the
    Jensen-Shannon divergence with natural logarithms; NULL if a side has no rows.
    """
    names = F.array(*[F.lit(n) for n in masked])
    left = value_counts(original, column, "").select(
        F.explode(names).alias("name"), "value", F.col("rows").alias("p"), F.lit(0).alias("q")
    )
    # A row per table without a value, so that a table compared with nothing still shows.
    stacked = left.unionByName(
        original.sparkSession.range(1).select(
            F.explode(names).alias("name"),
            F.lit(None).cast("string").alias("value"),
            F.lit(0).alias("p"),
            F.lit(0).alias("q"),
        )
    )
    for name, table in masked.items():
        stacked = stacked.unionByName(
            value_counts(table, column, name).select(
                "name", "value", F.lit(0).alias("p"), F.col("rows").alias("q")
            )
        )
    joint = stacked.groupBy("name", "value").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    totals = joint.groupBy("name").agg(F.sum("p").alias("p_all"), F.sum("q").alias("q_all"))
    named = totals.select(F.col("name").alias("_name"), "p_all", "q_all")
    # One row per masked table given by the caller.
    shares = joint.join(F.broadcast(named), F.col("name") == F.col("_name")).select(
        "name",
        "p",
        "q",
        F.try_divide(F.col("p").cast("double"), F.col("p_all")).alias("ps"),
        F.try_divide(F.col("q").cast("double"), F.col("q_all")).alias("qs"),
    )

    def part(share: Column) -> Column:
        middle = (F.col("ps") + F.col("qs")) / F.lit(2.0)
        return F.when(share > 0, share * F.log(share / middle)).otherwise(
            F.when(share == 0, F.lit(0.0))
        )

    measured = shares.groupBy("name").agg(
        F.count_if(F.col("p") > 0).alias("original_distinct"),
        F.count_if(F.col("q") > 0).alias("masked_distinct"),
        F.sum(part(F.col("ps")) + part(F.col("qs"))).alias("_sum"),
    )
    ratio = F.coalesce(
        F.try_divide(F.col("masked_distinct").cast("double"), F.col("original_distinct")),
        F.lit(0.0),
    )
    return measured.select(
        "name",
        "original_distinct",
        "masked_distinct",
        ratio.alias("cardinality_ratio"),
        F.sqrt(
            F.when(F.col("_sum") < 0, F.lit(0.0)).otherwise(F.col("_sum") / F.lit(2.0))
        ).alias("js_distance"),
    )


def cardinality_ratio(original: DataFrame, masked: DataFrame, column: str) -> DataFrame:
    """One row: distinct masked values over distinct original values."""
    return compare_distributions(original, {"masked": masked}, column).select(
        "original_distinct", "masked_distinct", "cardinality_ratio"
    )


def js_distance(original: DataFrame, masked: DataFrame, column: str) -> DataFrame:
    """One row: Jensen-Shannon distance of the value distributions."""
    return compare_distributions(original, {"masked": masked}, column).select("js_distance")


def comparison_report(
    original: DataFrame, masked: Mapping[str, DataFrame], column: str = "occupation"
) -> DataFrame:
    """Cardinality ratio and distance per masked table, rounded to 3 digits."""
    return compare_distributions(original, masked, column).select(
        F.col("name").alias("masking_function"),
        F.round("cardinality_ratio", 3).alias("cardinality_ratio"),
        F.round("js_distance", 3).alias("js_distance"),
    )
