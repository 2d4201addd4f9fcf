"""Distinct counts by sketches that are stored and merged, for tables that keep growing.

A sketch holds what is needed to estimate how many different values it has seen, in a few
kilobytes however many there were. Sketches of parts of a table merge into the sketch of the whole, so
new data is sketched by itself and old data not read again. The counts are estimates; where
an exact count is wanted, `workloads.distinct_by` and its like remain.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sources.swap import replace_parquet

# 2^12 registers: 2.6 kilobytes a sketch.
LOG_REGISTERS = 12


def relative_error(log_registers: int = LOG_REGISTERS, deviations: float = 3.0) -> float:
    """The share by which an estimate misses at most, at so many standard deviations.

    1.04 / sqrt(registers) is the method's published standard error.
    """
    return deviations * 1.04 / math.sqrt(1 << log_registers)


def sketch_by(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    log_registers: int = LOG_REGISTERS,
) -> DataFrame:
    """keys, rows, and a sketch of the values of each column per group; nulls are no values.

    Values are sketched by their text form, so parts whose types differ still merge. Rows
    are reduced to sketches before the shuffle: a hot group sends one per task.
    """
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.hll_sketch_agg(F.col(c).cast("string"), F.lit(log_registers)).alias(f"{c}_sketch")
            for c in columns
        ],
    )


def merge(sketches: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per group from the rows of several parts; fewer keys than before roll groups up."""
    return sketches.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        *[F.hll_union_agg(F.col(f"{c}_sketch")).alias(f"{c}_sketch") for c in columns],
    )


def estimated(column: str) -> Column:
    """The distinct values of a sketched column."""
    return F.hll_sketch_estimate(F.col(f"{column}_sketch"))


def estimates(
    sketches: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """keys, rows, and the estimated distinct values of each column, parts merged."""
    merged = merge(sketches, keys, columns)
    return merged.select(*keys, "rows", *[estimated(c).alias(c) for c in columns])


def store_part(
    df: DataFrame,
    path: str,
    part: str,
    keys: Sequence[str],
    columns: Sequence[str],
    log_registers: int = LOG_REGISTERS,
) -> None:
    """Sketch one part of a table into `path`; a part stored before is replaced, not added.

    So a load that is repeated after a failure counts once.
    """
    if not part or "/" in part or "=" in part or part.startswith(("_", ".")):
        raise ValueError(f"no name for a part: {part!r}")
    replace_parquet(sketch_by(df, keys, columns, log_registers), f"{path}/part={part}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The sketches of all parts, `part` beside them."""
    return spark.read.option("basePath", path).parquet(f"{path}/part=*")


def distinct_ratios(
    original: DataFrame, masked: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """(column, original_distinct, masked_distinct, cardinality_ratio) from the stored sketches of two tables.

    What `utility.cardinality_ratio` counts, by estimates: the share of a column's values that a
    mask leaves apart. An original column without values has no ratio.
    """

    def long(sketches: DataFrame, name: str) -> DataFrame:
        merged = merge(sketches, [], columns)
        cells = [F.struct(F.lit(c).alias("column"), estimated(c).alias(name)) for c in columns]
        return merged.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")

    both = long(original, "original_distinct").join(long(masked, "masked_distinct"), "column")
    ratio = F.try_divide(F.col("masked_distinct").cast("double"), F.col("original_distinct"))
    return both.withColumn("cardinality_ratio", ratio)
