"""Exact global positions without sorting the table in one task.

Rows go to buckets whose order agrees with the wanted order. Each bucket numbers
its own rows; the counts of earlier buckets are added. Bucket borders are fixed
by the data, not sampled, so a recomputed task numbers its rows as before.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.functions import prf

# Large enough that a map task sends fewer bucket counts than it has rows.
ROWS_PER_BUCKET = 1_000_000
# Smaller tables are cut into pieces of at least this many rows, to use all cores.
_SMALL_BUCKET = 10_000
# Buckets per block where blocks are summed before their buckets.
_BLOCK_BITS = 20


def bucket_starts(counts: DataFrame, bucket: str, weight: str, levels: int = 0) -> DataFrame:
    """(bucket, weight, before) with `before` = total weight of all smaller buckets.

    Without levels the bucket table is summed in one task; it has a row per bucket,
    not per row. Each level first sums blocks of about a million buckets, so that no
    window exceeds a block however many buckets there are.
    """
    if levels == 0:
        earlier = W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
        return counts.select(
            bucket, weight, F.coalesce(F.sum(weight).over(earlier), F.lit(0)).alias("before")
        )
    block = f"_block{levels}"
    blocked = counts.withColumn(block, F.shiftright(F.col(bucket), _BLOCK_BITS))
    totals = blocked.groupBy(block).agg(F.sum(weight).alias("_total"))
    bases = bucket_starts(totals, block, "_total", levels - 1).select(
        F.col(block).alias("_base_block"), F.col("before").alias("_base")
    )
    earlier = W.partitionBy(block).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return blocked.join(bases, F.col(block) == F.col("_base_block")).select(
        bucket,
        weight,
        (F.col("_base") + F.coalesce(F.sum(weight).over(earlier), F.lit(0))).alias("before"),
    )


def bucketed_rank(
    df: DataFrame, bucket: Column, order: Sequence[Column], name: str = "rank", levels: int = 0
) -> DataFrame:
    """Add the 1-based position in the order (bucket, *order); the order must be total.

    Rows are numbered in their buckets before they meet the buckets' starts, and only the starts
    are ever broadcast (without levels; with them both sides are merged). Spark's own choice
    goes by sizes guessed from files, which miss rows made by an explode.
    """
    placed = df.withColumn("_bucket", bucket)
    counts = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    starts = bucket_starts(counts, "_bucket", "_rows", levels).select("_bucket", "before")
    within = W.partitionBy("_bucket").orderBy(*order)
    return (
        placed.withColumn("_nth_there", F.row_number().over(within))
        .join(starts.hint("merge") if levels else F.broadcast(starts), "_bucket")
        .withColumn(name, F.col("before") + F.col("_nth_there"))
        .drop("_bucket", "before", "_nth_there")
    )


def _total(source: DataFrame, known: int | Column | None) -> Column:
    if isinstance(known, Column):
        return known
    if known is not None:
        return F.lit(known).cast("bigint")
    return source.agg(F.count(F.lit(1)).alias("n")).scalar()


def keyed_rank(
    df: DataFrame,
    ident: str,
    key: str,
    label: str,
    name: str = "rank",
    *,
    total_rows: int | Column | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Position of each row in a random order fixed by the key; `ident` must be unique.

    Draws are uniform, so buckets of equal width hold equally many rows. Their number
    follows the table's size; pass `total_rows` where it is known, or one count for several
    ranks, to save counting.
    """
    total = _total(df, total_rows)
    cores = df.sparkSession.sparkContext.defaultParallelism
    buckets = F.greatest(
        F.ceil(total / F.lit(rows_per_bucket)),
        F.least(F.ceil(total / F.lit(_SMALL_BUCKET)), F.lit(cores)),
        F.lit(1),
    )
    drawn = df.withColumn("_draw", prf.uniform(key, label, F.col(ident)))
    bucket = F.floor(F.col("_draw") * buckets)
    return bucketed_rank(drawn, bucket, [F.col("_draw"), F.col(ident)], name).drop("_draw")


def dense_ids(
    df: DataFrame, order: str, name: str = "id", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Ids 1..N in the order of a unique integer column.

    A bucket is a range of `rows_per_bucket` integers, so it cannot hold more
    rows than that, however the values are spread. Widely spread values make many
    buckets; one level of blocks brings even 64-bit values down to a few million.
    """
    bucket = F.floor(F.col(order) / F.lit(rows_per_bucket))
    ranked = bucketed_rank(df, bucket, [F.col(order)], "_dense_id", levels=1)
    kept = [F.col(c) for c in df.columns if c != name]
    return ranked.select(F.col("_dense_id").alias(name), *kept)


def exact_sample(
    df: DataFrame,
    ident: str,
    rows: int,
    key: str,
    label: str = "sample",
    total_rows: int | None = None,
) -> DataFrame:
    """Uniform sample of exactly `rows` rows (all, when there are fewer).

    The sample is every row up to the `rows`-th in the keyed order. Draws are uniform,
    so that row's draw is close to rows/total: rows below a margin around it are only
    counted, and only those within it, about sixteen times the root of `rows`, are put
    in order. The table itself is filtered in place, never shuffled or sorted.

    The margin is eight deviations and more. Should it miss the border row, which
    takes repeated identifiers, the query fails rather than return another size.
    """
    if rows <= 0:
        return df.limit(0)
    total = _total(df, total_rows)
    margin = 8.0 * math.sqrt(rows) + 40.0
    low = F.try_divide(F.lit(rows - margin), total)
    high = F.try_divide(F.lit(rows + margin), total)
    mark = F.struct(
        prf.uniform(key, label, F.col(ident)).alias("draw"), F.col(ident).alias("ident")
    )
    marks = df.select(mark.alias("mark"))
    draw = F.col("mark.draw")
    below = marks.where(draw < low).agg(F.count(F.lit(1)).alias("n")).scalar()
    last = (
        marks.where((draw >= low) & (draw < high))
        .withColumn("_row", F.row_number().over(W.orderBy("mark")))
        .where(F.col("_row") + below == rows)
        .select("mark")
        .scalar()
    )
    missed = F.raise_error(F.lit(f"no unique border row: is {ident} unique?")).cast("boolean")
    return df.where(
        F.when(total <= rows, F.lit(True)).otherwise(F.coalesce(mark <= last, missed))
    )
