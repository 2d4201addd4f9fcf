"""k-anonymity: generalize, check, suppress, and what that costs.

Everything is derived from one table of group sizes over the quasi-identifiers.
A row with a null quasi-identifier belongs to no group and is always suppressed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.functions.masks import floor_bucket
from veilframe.functions.taxonomy import KANON_EDUCATION
from veilframe.operators.lookup import HOT_KEYS, lookup_join
from veilframe.operators.rank import ROWS_PER_BUCKET, dense_ids
from veilframe.session import stored_once
from veilframe.sources.swap import replace_parquet

QUASI_IDENTIFIERS = ("age_generalized", "education_generalized", "sex", "race")
K_VALUES = (2, 5, 10, 20)
# Ranges of ids per block, where ranges are summed up by blocks.
_BLOCK_BITS = 20

# Columns of the k-anonymous table, after its own id.
OUTPUT_COLUMNS = (
    "age_generalized", "education_generalized", "sex", "race", "workclass", "occupation",
    "marital_status", "relationship", "capital_gain", "capital_loss", "hours_per_week",
    "native_country", "income",
)


def generalize(df: DataFrame, age_bucket: int = 5) -> DataFrame:
    """Add the generalized age and education."""
    return df.withColumns(
        {
            "age_generalized": floor_bucket(F.col("age"), age_bucket),
            "education_generalized": KANON_EDUCATION.column(F.col("education")),
        }
    )


def _identified(df: DataFrame, quasi_identifiers: Sequence[str]) -> DataFrame:
    return df.where(_complete(quasi_identifiers))


def group_sizes(df: DataFrame, quasi_identifiers: Sequence[str]) -> DataFrame:
    """(quasi-identifiers, rows), one row per group."""
    return (
        _identified(df, quasi_identifiers)
        .groupBy(*quasi_identifiers)
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def check(sizes: DataFrame, k: int) -> DataFrame:
    """One row: is every group at least k, the smallest size, how many groups are below k."""
    return sizes.agg(
        (F.min("rows") >= k).alias("satisfied"),
        F.min("rows").alias("min_group"),
        F.count_if(F.col("rows") < k).alias("violating_groups"),
    )


def suppress(
    df: DataFrame,
    quasi_identifiers: Sequence[str],
    k: int,
    sizes: DataFrame | None = None,
    hot_keys: int | None = None,
) -> DataFrame:
    """The rows whose group has at least k members; `hot_keys` as in `lookup_join`."""
    if sizes is None:
        sizes = group_sizes(df, quasi_identifiers)
    kept = sizes.where(F.col("rows") >= k).withColumn("_valid", F.lit(True))
    marked = lookup_join(
        _identified(df, quasi_identifiers), kept, quasi_identifiers, "_valid", "rows", hot_keys
    )
    return marked.where(F.col("_valid")).drop("_valid")


def sweep(
    df: DataFrame, quasi_identifiers: Sequence[str], ks: Sequence[int] = K_VALUES
) -> DataFrame:
    """Per k: check before, check after suppression, rows kept and suppressed.

    Rows are read once. Each k only adds a column pair to the aggregation over the
    size table, so the sweep costs no more shuffles than a single k.
    """
    sizes = df.groupBy(*quasi_identifiers).agg(F.count(F.lit(1)).alias("rows"))
    return sweep_sizes(sizes, quasi_identifiers, ks)


def sweep_sizes(
    sizes: DataFrame, quasi_identifiers: Sequence[str], ks: Sequence[int] = K_VALUES
) -> DataFrame:
    """`sweep` from the rows per combination of quasi-identifiers, nulls included."""
    size = F.when(_complete(quasi_identifiers), F.col("rows"))
    measured = sizes.select(
        F.col("rows").alias("all_rows"), size.alias("rows")
    ).agg(
        F.coalesce(F.sum("all_rows"), F.lit(0)).alias("original_rows"),
        F.min("rows").alias("min_group_before"),
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("k"),
                    F.count_if(F.col("rows") < k).alias("violating_groups"),
                    F.coalesce(
                        F.sum(F.when(F.col("rows") >= k, F.col("rows"))), F.lit(0)
                    ).alias("final_rows"),
                    F.min(F.when(F.col("rows") >= k, F.col("rows"))).alias("min_group_after"),
                )
                for k in ks
            ]
        ).alias("per_k"),
    )
    flat = measured.select(
        "original_rows", "min_group_before", F.explode("per_k").alias("s")
    ).select("original_rows", "min_group_before", "s.*")
    suppressed = F.col("original_rows") - F.col("final_rows")
    return flat.select(
        "k",
        "original_rows",
        "min_group_before",
        "violating_groups",
        "final_rows",
        suppressed.alias("suppressed_rows"),
        F.try_divide(suppressed.cast("double"), F.col("original_rows")).alias("suppression_rate"),
        "min_group_after",
        (F.col("min_group_after") >= F.col("k")).alias("satisfied_after"),
    )


def _complete(columns: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def sized_rows(
    df: DataFrame,
    age_bucket: int = 5,
    quasi_identifiers: Sequence[str] = QUASI_IDENTIFIERS,
    columns: Sequence[str] = OUTPUT_COLUMNS,
    ident: str = "id",
) -> DataFrame:
    """Generalized rows in the output layout with the size of their group, stored.

    Every k-anonymous table is a filter of this one, so a sweep over k reads the source
    no more often than a single k does.
    """
    rows = generalize(df, age_bucket)
    sizes = group_sizes(rows, quasi_identifiers)
    kept = list(dict.fromkeys([ident, *columns, *quasi_identifiers]))
    sized = lookup_join(
        _identified(rows, quasi_identifiers).select(*kept),
        sizes.withColumn("group_rows", F.col("rows")),
        quasi_identifiers,
        "group_rows",
        "rows",
    )
    return stored_once(sized, "kanon-rows")


def anonymous_table(
    df: DataFrame,
    k: int,
    age_bucket: int = 5,
    quasi_identifiers: Sequence[str] = QUASI_IDENTIFIERS,
    columns: Sequence[str] = OUTPUT_COLUMNS,
    ident: str = "id",
    fresh_ids: bool = True,
    sized: DataFrame | None = None,
) -> DataFrame:
    """Generalized rows of groups of at least k in the output layout, under fresh ids 1..N.

    Fresh ids follow the order of the old ones, which are dropped. Numbering reads its
    input several times, hence from the stored `sized_rows`, which may be passed on from
    one k to the next. Without ids the rows are filtered as they are read.
    """
    if not fresh_ids and sized is None:
        return suppress(generalize(df, age_bucket), quasi_identifiers, k).select(*columns)
    if sized is None:
        sized = sized_rows(df, age_bucket, quasi_identifiers, columns, ident)
    kept = sized.where(F.col("group_rows") >= k)
    if not fresh_ids:
        return kept.select(*columns)
    return dense_ids(kept.select(ident, *columns), ident, ident)


def _banded(
    rows: DataFrame,
    sizes: DataFrame,
    quasi_identifiers: Sequence[str],
    ks: Sequence[int],
) -> DataFrame:
    """Rows of groups of at least the smallest k, with `band`, the largest k they suffice for.

    Groups are far fewer than rows as a rule: up to HOT_KEYS of them are broadcast and the
    rows stay in place. More are joined, hot ones still in place.
    """
    band = F.lit(None).cast("int")
    for k in sorted(ks):
        band = F.when(F.col("rows") >= k, F.lit(k)).otherwise(band)
    banded = sizes.where(F.col("rows") >= min(ks)).withColumn("band", band)
    if sizes.count() <= HOT_KEYS:
        groups = banded.select(*[F.col(q).alias(f"_{q}") for q in quasi_identifiers], "band")
        same = [F.col(q) == F.col(f"_{q}") for q in quasi_identifiers]
        return rows.join(F.broadcast(groups), same).select(*rows.columns, "band")
    marked = lookup_join(
        _identified(rows, quasi_identifiers), banded, quasi_identifiers, "band", "rows"
    )
    return marked.where(F.col("band").isNotNull())


def _numbered_for_all(
    rows: DataFrame, ident: str, ks: Sequence[int], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """`rows` with `id_k<k>` for each k: ids 1..N of the rows with `band` >= k, else null.

    One ranking for all k: rows go to ranges of the old id once, where a running count per k
    is added to the count of earlier ranges.
    """
    bucket = F.floor(F.col(ident) / F.lit(rows_per_bucket))
    placed = rows.withColumn("_bucket", bucket)
    counts = placed.groupBy("_bucket").agg(
        *[F.count_if(F.col("band") >= k).alias(f"_rows{k}") for k in ks]
    )
    counts = stored_once(counts, "kanon-ranges")
    # Two levels, as in `bucket_starts`, but with the sums of all k side by side.
    blocked = counts.withColumn("_block", F.shiftright("_bucket", _BLOCK_BITS))

    def before(k: int, window) -> Column:
        return F.coalesce(F.sum(f"_rows{k}").over(window), F.lit(0))

    totals = blocked.groupBy("_block").agg(*[F.sum(f"_rows{k}").alias(f"_rows{k}") for k in ks])
    earlier = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(
        F.col("_block").alias("_of_block"), *[before(k, earlier).alias(f"_base{k}") for k in ks]
    )
    inside = W.partitionBy("_block").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = blocked.join(bases, F.col("_block") == F.col("_of_block")).select(
        F.col("_bucket").alias("_of"),
        *[(F.col(f"_base{k}") + before(k, inside)).alias(f"_before{k}") for k in ks],
    )
    within = W.partitionBy("_bucket").orderBy(ident).rowsBetween(W.unboundedPreceding, W.currentRow)
    ids = {
        f"id_k{k}": F.when(
            F.col("band") >= k, F.col(f"_before{k}") + F.count_if(F.col("band") >= k).over(within)
        )
        for k in ks
    }
    return placed.join(starts, F.col("_bucket") == F.col("_of")).select(
        *[c.alias(name) for name, c in ids.items()], *rows.columns
    )


def publish(
    df: DataFrame,
    folder: str,
    ks: Sequence[int] = K_VALUES,
    age_bucket: int = 5,
    quasi_identifiers: Sequence[str] = QUASI_IDENTIFIERS,
    columns: Sequence[str] = OUTPUT_COLUMNS,
    ident: str = "id",
) -> DataFrame:
    """Write the k-anonymous tables of all k to `folder` and report what each keeps.

    Rows are stored once, in a partition per band: the largest k their group suffices for.
    The table of a k is the union of the bands from k on, under ids 1..N of its own in the
    order of the old ones, which are dropped; `published` reads it. The source is read
    twice: summed up for all sizes and the report, then for the rows.
    """
    ks = sorted(set(ks))
    rows = generalize(df, age_bucket)
    cells = utility_cells(rows, quasi_identifiers)
    sizes = stored_once(
        cells.groupBy(*quasi_identifiers).agg(F.sum("rows").alias("rows")), "kanon-sizes"
    )
    kept = list(dict.fromkeys([ident, *columns, *quasi_identifiers]))
    groups = sizes.where(_complete(quasi_identifiers))
    banded = stored_once(
        _banded(rows.select(*kept), groups, quasi_identifiers, ks), "kanon-rows"
    )
    numbered = _numbered_for_all(banded, ident, ks)
    replace_parquet(
        numbered.select(*[f"id_k{k}" for k in ks], *columns, "band"),
        f"{folder}/rows",
        # Without rows there is no partition, and a file must hold the schema.
        partition_by=() if banded.isEmpty() else ("band",),
    )
    utility = mean_utility(utility_of_cells(cells, quasi_identifiers, ks=ks))
    return (
        sweep_sizes(sizes, quasi_identifiers, ks)
        .join(utility, "k", "left")
        .select(
            "k",
            "original_rows",
            "final_rows",
            "suppressed_rows",
            "suppression_rate",
            "mae",
            "relative_error",
        )
    )


def published(
    spark: SparkSession, folder: str, k: int, columns: Sequence[str] = OUTPUT_COLUMNS
) -> DataFrame:
    """The k-anonymous table that `publish` wrote for one of its k; smaller bands are not read."""
    rows = spark.read.parquet(f"{folder}/rows")
    if f"id_k{k}" not in rows.columns:
        raise ValueError(f"nothing was published for k = {k}")
    return rows.where(F.col("band") >= k).select(F.col(f"id_k{k}").alias("id"), *columns)


@dataclass(frozen=True)
class GroupQuery:
    """`count` of rows, or `avg` of a measure, per value of one key."""

    name: str
    key: str
    measure: str | None = None


UTILITY_QUERIES = (
    GroupQuery("count_by_education", "education_generalized"),
    GroupQuery("avg_age_by_sex", "sex", "age_generalized"),
    GroupQuery("count_by_income", "income"),
)


def query_utility(
    df: DataFrame,
    quasi_identifiers: Sequence[str] = QUASI_IDENTIFIERS,
    queries: Sequence[GroupQuery] = UTILITY_QUERIES,
    ks: Sequence[int] = K_VALUES,
) -> DataFrame:
    """(k, query, mae, relative_error) of group queries on the suppressed table.

    The rows are first summed up per quasi-identifier group and query key, and those
    cells stored; every query and every k then works on the cells alone.

    `mae` averages over keys both answers have; `relative_error` sums over the
    original keys (a lost key counts as 0) and divides by the number of them.
    """
    return utility_of_cells(
        utility_cells(df, quasi_identifiers, queries), quasi_identifiers, queries, ks
    )


def utility_cells(
    df: DataFrame,
    quasi_identifiers: Sequence[str] = QUASI_IDENTIFIERS,
    queries: Sequence[GroupQuery] = UTILITY_QUERIES,
) -> DataFrame:
    """Stored counts and sums per quasi-identifier group and query key."""
    measures = sorted({q.measure for q in queries if q.measure})
    extra = [q.key for q in queries if q.key not in quasi_identifiers]
    cell_keys = list(dict.fromkeys([*quasi_identifiers, *extra]))
    cells = df.groupBy(*cell_keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(m).alias(f"sum_{m}") for m in measures],
        *[F.count(m).alias(f"n_{m}") for m in measures],
    )
    return stored_once(cells, "utility-cells")


def utility_of_cells(
    cells: DataFrame,
    quasi_identifiers: Sequence[str] = QUASI_IDENTIFIERS,
    queries: Sequence[GroupQuery] = UTILITY_QUERIES,
    ks: Sequence[int] = K_VALUES,
) -> DataFrame:
    """`query_utility` from the cells."""
    sizes = (
        _identified(cells, quasi_identifiers)
        .groupBy(*quasi_identifiers)
        .agg(F.sum("rows").alias("group_rows"), F.count(F.lit(1)).alias("cells"))
    )
    sized = lookup_join(cells, sizes, quasi_identifiers, "group_rows", "cells")

    answers = F.array(
        *[
            F.struct(
                F.lit(q.name).alias("query"),
                F.col(q.key).cast("string").alias("key"),
                F.lit(q.measure is not None).alias("is_avg"),
                (F.col(f"sum_{q.measure}") if q.measure else F.col("rows"))
                .cast("double")
                .alias("total"),
                (F.col(f"n_{q.measure}") if q.measure else F.lit(0).cast("bigint")).alias("n"),
            )
            for q in queries
        ]
    )
    long = sized.select(F.explode(answers).alias("a"), "group_rows").select("a.*", "group_rows")
    kept = {k: F.col("group_rows") >= k for k in ks}
    per_key = long.groupBy("query", "key", "is_avg").agg(
        F.sum("total").alias("total"),
        F.sum("n").alias("n"),
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("k"),
                    F.sum(F.when(kept[k], F.col("total"))).alias("total"),
                    F.sum(F.when(kept[k], F.col("n"))).alias("n"),
                    F.count_if(kept[k]).alias("cells"),
                )
                for k in ks
            ]
        ).alias("per_k"),
    )
    spread = per_key.select("query", "key", "is_avg", "total", "n", F.explode("per_k").alias("s"))
    original = _answer(F.col("total"), F.col("n"))
    masked = F.when(F.col("s.cells") > 0, _answer(F.col("s.total"), F.col("s.n")))
    compared = spread.select(
        F.col("s.k").alias("k"),
        "query",
        original.alias("original"),
        masked.alias("masked"),
        (F.col("s.cells") > 0).alias("answered"),
    )
    gap = F.abs(F.col("original") - F.col("masked"))
    lost = F.abs(F.col("original") - F.coalesce(F.col("masked"), F.lit(0.0)))
    relative = F.when(F.col("original") > 0, lost / F.col("original")).otherwise(F.lit(0.0))
    return (
        compared.groupBy("k", "query")
        .agg(
            F.coalesce(F.avg(F.when(F.col("answered"), gap)), F.lit(0.0)).alias("mae"),
            (F.sum(relative) / F.count(F.lit(1))).alias("relative_error"),
            F.bool_or("answered").alias("_any"),
        )
        .where("_any")
        .drop("_any")
    )


def _answer(total: Column, n: Column) -> Column:
    return F.when(F.col("is_avg"), F.try_divide(total, n)).otherwise(total)


def mean_utility(utility: DataFrame) -> DataFrame:
    """(k, mae, relative_error) averaged over the queries."""
    return utility.groupBy("k").agg(
        F.avg("mae").alias("mae"), F.avg("relative_error").alias("relative_error")
    )


def cardinality_loss(
    df: DataFrame, quasi_identifiers: Sequence[str], ks: Sequence[int] = K_VALUES
) -> DataFrame:
    """(k, column, original, kept, loss): share of a quasi-identifier's values lost.

    Distinct values are found in the table of groups, which is far smaller than the
    table. The value counts on both sides ignore NULL.
    """
    sizes = df.groupBy(*quasi_identifiers).agg(F.count(F.lit(1)).alias("rows"))
    complete = _complete(quasi_identifiers)
    largest = (
        sizes.select(
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(c).alias("column"), F.col(c).cast("string").alias("value")
                        )
                        for c in quasi_identifiers
                    ]
                )
            ).alias("cell"),
            F.when(complete, F.col("rows")).alias("rows"),
        )
        .select("cell.*", "rows")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.max("rows").alias("largest"))
    )
    counted = largest.groupBy("column").agg(
        F.count(F.lit(1)).alias("original"),
        F.array(
            *[
                F.struct(F.lit(k).alias("k"), F.count_if(F.col("largest") >= k).alias("kept"))
                for k in ks
            ]
        ).alias("per_k"),
    )
    flat = counted.select("column", "original", F.explode("per_k").alias("s"))
    return flat.select(
        F.col("s.k").alias("k"),
        "column",
        "original",
        F.col("s.kept").alias("kept"),
        (F.lit(1.0) - F.col("s.kept") / F.col("original")).alias("loss"),
    )
