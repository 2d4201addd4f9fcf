"""Scale a table to a wanted number of rows while keeping its distributions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import prf
from veilframe.operators.rank import exact_sample, keyed_rank

# Share of a standard deviation added, and of cells replaced.
NOISE_SHARE = 0.05
REPLACED_SHARE = 0.05
# A column with more distinct values than this is not held in one array.
ARRAY_VALUES = 10_000
_SPREAD = 4_096
_COPIES_PER_BLOCK = 256
# Stands for NULL among a column's values.
_NULL = "\x00"


@dataclass(frozen=True)
class Profile:
    """What perturbing needs to know about the base table; one row of aggregates."""

    rows: int
    numeric: dict[str, tuple[float, object, object]]
    distinct: dict[str, int]


def profile(base: DataFrame, ident: str = "id") -> Profile:
    """Row count, (stddev, min, max) per numeric and distinct values per other column."""
    fields = [f for f in base.schema.fields if f.name != ident]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    others = [f.name for f in fields if not isinstance(f.dataType, T.NumericType)]
    wanted = [F.count(F.lit(1)).alias("rows")]
    for c in numeric:
        wanted.append(
            F.struct(
                F.stddev_samp(F.col(c).cast("double")).alias("std"),
                F.min(c).alias("low"),
                F.max(c).alias("high"),
            ).alias(f"n_{c}")
        )
    found = base.agg(*wanted).first()
    distinct = _distinct_counts(base, others)
    return Profile(
        rows=found["rows"],
        numeric={
            c: (found[f"n_{c}"]["std"] or 0.0, found[f"n_{c}"]["low"], found[f"n_{c}"]["high"])
            for c in numeric
        },
        distinct=distinct,
    )


def _distinct_counts(base: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct values of each column, NULL counting as one: one shuffle of (column, value)."""
    if not columns:
        return {}
    cells = F.array(
        *[F.struct(F.lit(i).alias("i"), _identity(c).alias("v")) for i, c in enumerate(columns)]
    )
    pairs = base.select(F.explode(cells).alias("cell")).select("cell.*").distinct()
    found = {r.i: r.n for r in pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: found.get(i, 0) for i, c in enumerate(columns)}


def _identity(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(_NULL))


def replicate(df: DataFrame, copies: int, ident: str = "id", name: str = "_row") -> DataFrame:
    """Every row `copies` times, told apart by the text `ident:copy` in `name`.

    Rows are first repeated once per block of copies and dealt by (id, block), then within
    their block, so the copies are made by all tasks however few partitions the base has.
    """
    blocks = -(-copies // _COPIES_PER_BLOCK)
    tasks = max(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        df.sparkSession.sparkContext.defaultParallelism,
    )
    first = F.col("_block") * _COPIES_PER_BLOCK + 1
    last = F.least((F.col("_block") + 1) * _COPIES_PER_BLOCK, F.lit(copies))
    return (
        df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        # A stated number of tasks: by their bytes the rows would be put into few.
        .repartition(tasks, F.col(ident), F.col("_block"))
        .withColumn("_copy", F.explode(F.sequence(first, last)))
        .withColumn(name, F.concat(F.col(ident).cast("string"), F.lit(":"), F.col("_copy")))
        .drop("_block", "_copy")
    )


def _moved_number(column: str, data_type: T.DataType, stats, key: str, row: str) -> Column:
    std, low, high = stats
    moved = F.col(column).cast("double") + prf.normal(key, column, F.col(row)) * F.lit(
        std * NOISE_SHARE
    )
    moved = F.least(F.greatest(moved, F.lit(float(low))), F.lit(float(high)))
    if isinstance(data_type, T.IntegralType):
        moved = F.rint(moved)
    return F.when(F.col(column).isNotNull(), moved.cast(data_type))


def perturb(
    df: DataFrame,
    base: DataFrame,
    ident: str = "id",
    row: str = "_row",
    key: str = "synth-key",
    known: Profile | None = None,
    array_values: int = ARRAY_VALUES,
) -> DataFrame:
    """Noise on numbers, a few replaced cells elsewhere; `row` names a unique text per row.

    Numbers move by a normal of 5% of the base's deviation and stay within the base's
    bounds. In other columns 5% of the cells get one of the base's distinct values
    (NULL included), each with the same chance. Values are numbered in a keyed order;
    `array_values` only decides whether the numbered values are held in an array or joined.
    """
    known = known or profile(base, ident)
    types = {f.name: f.dataType for f in df.schema.fields}
    changed: dict[str, Column] = {}
    long_columns = []
    for column, stats in known.numeric.items():
        if stats[1] is not None:
            changed[column] = _moved_number(column, types[column], stats, key, row)
    for column, size in known.distinct.items():
        if size == 0:
            continue
        if size > array_values:
            long_columns.append(column)
            continue
        # Bounded by `array_values`, which the profile has just checked.
        numbered = F.struct(
            _dictionary_draw(column, key).alias("draw"), _identity(column).alias("ident"), column
        )
        values = base.agg(F.sort_array(F.collect_set(numbered)).alias("v")).scalar()
        chosen = F.element_at(
            values, prf.index_below(prf.uniform(key, column, F.col(row), 1), size)
        ).getField(column)
        replaced = prf.uniform(key, column, F.col(row)) < F.lit(REPLACED_SHARE)
        changed[column] = F.when(replaced, chosen).otherwise(F.col(column))
    result = df.withColumns(changed) if changed else df
    for column in long_columns:
        result = _replace_by_dictionary(result, base, column, known.distinct[column], key, row)
    return result


def _dictionary_draw(column: str, key: str) -> Column:
    return prf.uniform(key, f"{column}.dictionary", _identity(column))


def _replace_by_dictionary(
    df: DataFrame, base: DataFrame, column: str, size: int, key: str, row: str
) -> DataFrame:
    """Replace 5% of the cells by a join with the numbered distinct values.

    Rows that keep their value get a negative number that matches nothing and
    spreads them over the join's partitions.
    """
    order = df.columns
    values = base.select(F.col(column).alias("_value"), _identity(column).alias("_ident")).distinct()
    numbered = keyed_rank(values, "_ident", key, f"{column}.dictionary", "_number").select(
        "_number", "_value"
    )
    replaced = prf.uniform(key, column, F.col(row)) < F.lit(REPLACED_SHARE)
    number = prf.index_below(prf.uniform(key, column, F.col(row), 1), size)
    nowhere = -F.pmod(F.xxhash64(row), F.lit(_SPREAD)) - 1
    wanted = df.withColumn("_wanted", F.when(replaced, number.cast("bigint")).otherwise(nowhere))
    joined = wanted.join(numbered, F.col("_wanted") == F.col("_number"), "left")
    new = F.when(F.col("_wanted") > 0, F.col("_value")).otherwise(F.col(column))
    return joined.withColumn(column, new).select(*order)


def scale_rows(
    base: DataFrame,
    target_rows: int,
    ident: str = "id",
    key: str = "synth-key",
    array_values: int = ARRAY_VALUES,
) -> DataFrame:
    """Exactly `target_rows` rows like those of `base`, with fresh ids 1..N.

    Up to the base's size this is a sample. Beyond, the base is repeated often
    enough, sampled and perturbed; noise depends on the row alone, so sampling first
    gives the same rows and spares the noise of those left out.
    """
    known = profile(base, ident)
    if known.rows == 0:
        return base
    copies = math.ceil(target_rows / known.rows)
    if copies <= 1:
        grown = base.withColumn("_row", F.col(ident).cast("string"))
        sample = exact_sample(grown, "_row", target_rows, key, total_rows=known.rows)
    else:
        copied = replicate(base, copies, ident)
        sample = exact_sample(copied, "_row", target_rows, key, total_rows=known.rows * copies)
        sample = perturb(sample, base, ident, "_row", key, known, array_values)
    ranked = keyed_rank(sample, "_row", key, "sample", "_new_id", total_rows=target_rows)
    return ranked.select(
        *[F.col("_new_id").alias(c) if c == ident else F.col(c) for c in base.columns]
    )
