"""Stable surrogates: one replacement per (column, value), kept in a mapping table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.functions.masks import hmac_sha256_hex
from veilframe.operators.lookup import HOT_KEYS
from veilframe.session import stored_once

# The surrogate's form.
PREFIX = "SRG-"
HEX_DIGITS = 16

MAPPING_SCHEMA = "column_name string, original_value string, surrogate_value string"


def empty_mapping(like: DataFrame) -> DataFrame:
    """A mapping without rows."""
    return like.sparkSession.createDataFrame([], MAPPING_SCHEMA)


def _surrogate(text: Column, key: str) -> Column:
    return F.concat(F.lit(PREFIX), F.substring(hmac_sha256_hex(text, key), 1, HEX_DIGITS))


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, original_value) of all cells of the listed columns, nulls left out."""
    cells = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(c).cast("string").alias("original_value")
        )
        for c in columns
    ]
    return (
        df.select(F.explode(F.array(*cells)).alias("cell"))
        .select("cell.*")
        .where(F.col("original_value").isNotNull())
    )


def extend_mapping(
    df: DataFrame, columns: Sequence[str], mapping: DataFrame | None = None, *, key: str
) -> DataFrame:
    """The mapping with an entry for every value of `columns` not yet in it.

    New surrogates are keyed digests, not random bytes, so a retried task makes the
    same ones. Entries already there never change. Two values that share a surrogate
    are told apart by a further digest of all but the first. The key is a secret.
    """
    mapping = empty_mapping(df) if mapping is None else mapping
    names = ["column_name", "original_value"]
    seen = _cells(df, columns).distinct()
    cell = F.concat_ws("|", *names)
    fresh = seen.join(mapping.select(*names), names, "left_anti").withColumn(
        "surrogate_value", _surrogate(cell, key)
    )
    both = mapping.select(*names, "surrogate_value", F.lit(0).alias("_new")).unionByName(
        fresh.withColumn("_new", F.lit(1))
    )
    same = W.partitionBy("surrogate_value").orderBy("_new", *names)
    numbered = both.withColumn("_nth", F.row_number().over(same))
    again = _surrogate(F.concat_ws("|", cell, F.col("_nth").cast("string")), key)
    return numbered.select(
        *names,
        F.when((F.col("_new") == 1) & (F.col("_nth") > 1), again)
        .otherwise(F.col("surrogate_value"))
        .alias("surrogate_value"),
    )


def apply_mapping(
    df: DataFrame,
    columns: Sequence[str],
    mapping: DataFrame,
    hot_keys: int | None = None,
) -> DataFrame:
    """Replace the values of `columns` by their surrogates; NULL stays NULL.

    The rows are stored under a number each, and one pass counts the values of all columns.
    Values that hold at least 1/hot_keys (default 1/HOT_KEYS) of all cells, at most so many, are
    broadcast and replaced in place. Of rows that hold another value, only the number and
    those cells are looked up, for all columns in one join in which no key is hot; the row
    itself moves once, to meet its surrogates, however many columns there are. All other rows
    stay where they are. A value the mapping lacks becomes NULL.
    """
    columns = list(columns)
    own = "_s"  # begins the names of helper columns, and of no given one
    while any(c.lower().startswith(own) for c in df.columns):
        own = f"_{own}"
    row, of = f"{own}row", f"{own}of"
    bound = HOT_KEYS if hot_keys is None else hot_keys
    # A written number is the same each time it is read, whatever made the rows.
    rows = stored_once(df.withColumn(row, F.monotonically_increasing_id()), "surrogate-rows")
    names = ["column_name", "original_value"]
    counts = _cells(rows, columns).groupBy(*names).agg(F.count(F.lit(1)).alias("rows"))
    known = stored_once(
        counts.join(mapping, names, "left").select(*names, "surrogate_value", "rows"),
        "surrogate-values",
    )
    total = known.agg(F.sum("rows").alias("n")).scalar()
    is_hot = F.col("rows") * F.lit(bound) >= total

    marked = rows
    for i, column in enumerate(columns):
        hot = known.where(is_hot & (F.col("column_name") == column)).select(
            F.col("original_value").alias(f"{own}key{i}"),
            F.col("surrogate_value").alias(f"{own}hot{i}"),
            F.lit(True).alias(f"{own}is_hot{i}"),
        )
        same = F.col(column).cast("string") == F.col(f"{own}key{i}")
        marked = marked.join(F.broadcast(hot), same, "left").drop(f"{own}key{i}")
    is_open = [F.col(c).isNotNull() & F.col(f"{own}is_hot{i}").isNull() for i, c in enumerate(columns)]
    any_open = reduce(or_, is_open)

    def result(part: DataFrame, cold: bool) -> DataFrame:
        found = {
            c: F.coalesce(F.col(f"{own}hot{i}"), F.col(f"{own}cold{i}")) if cold else F.col(f"{own}hot{i}")
            for i, c in enumerate(columns)
        }
        return part.select(*[found[c].alias(c) if c in found else F.col(c) for c in df.columns])

    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.when(is_open[i], F.col(c).cast("string")).alias("original_value"),
            )
            for i, c in enumerate(columns)
        ]
    )
    narrow = (
        marked.where(any_open)
        .select(row, F.explode(cells).alias("cell"))
        .select(row, "cell.*")
        .where(F.col("original_value").isNotNull())
    )
    cold = known.where(~is_hot).select(*names, "surrogate_value")
    pivoted = (
        narrow.join(cold, names)
        .groupBy(F.col(row).alias(of))
        .agg(
            *[
                F.max(F.when(F.col("column_name") == c, F.col("surrogate_value"))).alias(f"{own}cold{i}")
                for i, c in enumerate(columns)
            ]
        )
    )
    moved = marked.where(any_open).join(pivoted, F.col(row) == F.col(of), "left")
    return result(marked.where(~any_open), False).unionByName(result(moved, True))


def clashes(mapping: DataFrame) -> DataFrame:
    """Surrogates given to more than one value; empty in a sound mapping."""
    return (
        mapping.groupBy("surrogate_value")
        .agg(F.count(F.lit(1)).alias("values"))
        .where(F.col("values") > 1)
    )
