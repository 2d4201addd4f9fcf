"""The analytic workloads, as functions of a DataFrame.

The same function runs over the raw table, a masked view, a stored masked copy or
`policy.read(df, role)`; column names default to the person tables'. Every limit
has a total order, so answers are defined: ties go by group key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stands for a missing category in the source files. Fixed value.
UNKNOWN = "?"


def exact_avg(df: DataFrame, column: str) -> Column:
    """Mean as an exact sum over a count for integers and decimals.

    A sum of doubles depends on the order rows arrive in; these do not.
    """
    if isinstance(df.schema[column].dataType, (T.IntegralType, T.DecimalType)):
        return F.try_divide(F.sum(column).cast("double"), F.count(column))
    return F.avg(column)


# --- lookups and ranges -------------------------------------------------------------------


def point_lookup(df: DataFrame, value: int = 5000, column: str = "id") -> DataFrame:
    """All columns of the rows with one key."""
    return df.where(F.col(column) == value)


def existence_probe(df: DataFrame, value: int, column: str = "id") -> DataFrame:
    """A 1 per row with the key; no other column is read."""
    return df.where(F.col(column) == value).select(F.lit(1).alias("found"))


def equality_count(df: DataFrame, value, column: str = "age") -> DataFrame:
    """Rows with one value in a column that is no key."""
    return df.where(F.col(column) == value).agg(F.count(F.lit(1)).alias("cnt"))


def range_count(df: DataFrame, low: int = 25, high: int = 45, column: str = "age") -> DataFrame:
    """Number of rows in a range, both ends included."""
    return df.where(F.col(column).between(low, high)).agg(F.count(F.lit(1)).alias("cnt"))


def range_avg(
    df: DataFrame,
    low: int = 30,
    high: int = 50,
    column: str = "age",
    measure: str = "billing_amount",
) -> DataFrame:
    """Mean of a measure in a range."""
    return df.where(F.col(column).between(low, high)).agg(
        exact_avg(df, measure).alias("avg_value")
    )


def above_avg(df: DataFrame, bound: int, column: str = "age", measure: str = "hours_per_week"):
    """Mean of a measure above a bound."""
    return df.where(F.col(column) > bound).agg(exact_avg(df, measure).alias("avg_value"))


def not_unknown(df: DataFrame, column: str) -> DataFrame:
    """Rows whose category is known: neither NULL nor the placeholder."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != UNKNOWN))


def null_safe_match(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows equal to `values` where a NULL is matched by NULL."""
    condition = F.lit(True)
    for column, value in values.items():
        condition = condition & F.col(column).eqNullSafe(F.lit(value))
    return df.where(condition)


# --- parameterised statements ------------------------------------------------------------------


def bound_range_groups(
    df: DataFrame, low: int, high: int, key: str = "education", column: str = "age", limit: int = 5
) -> DataFrame:
    """First groups, by key, of a count over a bound range."""
    return (
        df.where(F.col(column).between(low, high))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.col(key).asc_nulls_last())
        .limit(limit)
    )


def sql_with_parameters(df: DataFrame, text: str, **parameters) -> DataFrame:
    """Run a SQL text over `{table}` with `:name` parameters bound, not pasted."""
    return df.sparkSession.sql(text, args=parameters, table=df)


def window_of_id(ident: Column) -> tuple[Column, Column]:
    """The age range a random id stands for in the load test. Fixed rule."""
    start = ident % 60
    return start + 18, start + 40


def range_groups_for_all(
    df: DataFrame, ids: DataFrame, ident: str, key: str, column: str = "age"
) -> DataFrame:
    """(range, group, count) for the age ranges of all given ids at once.

    Ids collapse to at most sixty ranges. Rows collapse to counts per (group, value);
    a range is spelled out as its values, so the match is an equi-join on counts.
    """
    low, high = window_of_id(F.col(ident))
    ranges = ids.select(low.cast("int").alias("low"), high.cast("int").alias("high")).distinct()
    wanted = ranges.select("low", "high", F.explode(F.sequence("low", "high")).alias("_value"))
    counts = df.groupBy(key, column).agg(F.count(F.lit(1)).alias("_rows"))
    return (
        counts.join(wanted, F.col(column) == F.col("_value"))
        .groupBy("low", "high", key)
        .agg(F.sum("_rows").alias("cnt"))
    )


# --- grouping ----------------------------------------------------------------------------------


def count_by(df: DataFrame, key: str, name: str = "cnt") -> DataFrame:
    """Rows per group, ordered by the group."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(key).asc_nulls_last())


def avg_by(df: DataFrame, key: str, measure: str, name: str) -> DataFrame:
    """Rows and mean per group."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("cnt"), exact_avg(df, measure).alias(name)
    )


def sum_by(df: DataFrame, key: str, measure: str, name: str) -> DataFrame:
    """Sum per group of the known categories."""
    return not_unknown(df, key).groupBy(key).agg(F.sum(measure).alias(name))


def top_pairs(
    df: DataFrame,
    keys: Sequence[str] = ("education", "income"),
    measure: str = "age",
    count_name: str = "cnt",
    avg_name: str = "avg_age",
    limit: int = 20,
) -> DataFrame:
    """Largest groups over two keys, with the mean of a measure."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias(count_name), exact_avg(df, measure).alias(avg_name))
        .orderBy(F.col(count_name).desc(), *[F.col(k).asc_nulls_last() for k in keys])
        .limit(limit)
    )


def top_groups(
    df: DataFrame,
    key: str = "occupation",
    averages: Mapping[str, str] | None = None,
    limit: int = 10,
) -> DataFrame:
    """Most frequent known categories with means of several measures."""
    averages = averages or {"age": "avg_age", "hours_per_week": "avg_hours"}
    return (
        not_unknown(df, key)
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("frequency"),
            *[exact_avg(df, m).alias(name) for m, name in averages.items()],
        )
        .orderBy(F.col("frequency").desc(), F.col(key))
        .limit(limit)
    )


def top_costs(
    df: DataFrame, key: str = "medication", measure: str = "billing_amount", limit: int = 15
) -> DataFrame:
    """Most frequent groups with mean, smallest and largest amount."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("prescription_count"),
            exact_avg(df, measure).alias("avg_cost"),
            F.min(measure).alias("min_cost"),
            F.max(measure).alias("max_cost"),
        )
        .orderBy(F.col("prescription_count").desc(), F.col(key))
        .limit(limit)
    )


def distinct_by(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Exact number of distinct values per group, largest first."""
    return (
        df.groupBy(key)
        .agg(F.count_distinct(value).alias(name))
        .orderBy(F.col(name).desc(), F.col(key).asc_nulls_last())
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the number of distinct values of each column.

    Cells are first reduced to the distinct (column, value) pairs, in one pass for
    all columns, then counted.
    """
    cells = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v"))
                    for i, c in enumerate(columns)
                ]
            )
        ).alias("cell")
    ).select("cell.*")
    pairs = cells.where(F.col("v").isNotNull()).distinct()
    per_column = pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return per_column.agg(
        *[
            F.coalesce(F.max(F.when(F.col("i") == i, F.col("n"))), F.lit(0)).alias(f"distinct_{c}")
            for i, c in enumerate(columns)
        ]
    )


def self_join_groups(
    df: DataFrame,
    group: str = "education",
    on: str = "occupation",
    measure: str = "age",
    above: int = 30,
    limit: int = 100,
    average: str = "avg_age",
) -> DataFrame:
    """Per group: pairs of rows that share `on`, both above a bound, and the mean measure.

    The pairs are never made. A row with key o takes part in as many pairs as there
    are rows with o, so both sides are summed up before they meet, and the join has
    one row per (key, group) however many rows share a key. A hot key's pair count
    outgrows 64 bits, hence `match_count` is a decimal; the mean is weighted in doubles,
    so fractional measures keep their fractions.
    """
    rows = df.where((F.col(measure) > above) & F.col(on).isNotNull())
    left = rows.groupBy(on, group).agg(
        F.count(F.lit(1)).cast("decimal(19,0)").alias("_n"),
        F.sum(measure).cast("double").alias("_total"),
    )
    right = left.groupBy(F.col(on).alias("_on")).agg(
        F.sum("_n").cast("decimal(19,0)").alias("_partners")
    )
    pairs = F.sum(F.col("_n") * F.col("_partners"))
    weighted = F.sum(F.col("_total") * F.col("_partners").cast("double"))
    return (
        left.join(right, F.col(on) == F.col("_on"))
        .groupBy(group)
        .agg(pairs.alias("match_count"), (weighted / pairs.cast("double")).alias(average))
        .orderBy(F.col(group).asc_nulls_last())
        .limit(limit)
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, rows) for several tables."""
    result = None
    for name, table in tables.items():
        row = table.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "rows"
        )
        result = row if result is None else result.unionByName(row)
    if result is None:
        raise ValueError("no tables")
    return result
