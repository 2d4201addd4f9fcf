"""Column shuffle: permute the values of a column over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.rank import ROWS_PER_BUCKET, keyed_rank


def shuffle_columns(
    df: DataFrame,
    columns: Sequence[str],
    ident: str = "id",
    key: str = "mask-key",
    rows_per_bucket: int = ROWS_PER_BUCKET,
    wanted: Sequence[str] | None = None,
) -> DataFrame:
    """Give every row the value at its position in another random order.

    Each column moves on its own. Only (ident, value) pairs are ranked and matched
    by position; the wide rows are shuffled once, for the final join on `ident`.
    With `wanted` only those columns are returned and only the moved ones among them cost
    a shuffle; what a column gets does not depend on which others are wanted.
    """
    kept = list(df.columns if wanted is None else wanted)
    columns = [c for c in columns if c in kept]
    if not columns:
        return df.select(*kept)
    # One count serves all ranks.
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()

    def ranked(rows: DataFrame, label: str) -> DataFrame:
        return keyed_rank(
            rows, ident, key, label, "_place", total_rows=total, rows_per_bucket=rows_per_bucket
        )

    places = ranked(df.select(ident), "place")
    for column in columns:
        values = ranked(df.select(ident, column), f"order.{column}")
        moved = values.select("_place", F.col(column).alias(f"_moved_{column}"))
        places = places.join(moved, "_place")
    moved_by_row = places.drop("_place").withColumnRenamed(ident, "_row")
    stay = list(dict.fromkeys([ident, *[c for c in kept if c not in columns]]))
    joined = df.select(*stay).join(moved_by_row, F.col(ident) == F.col("_row"))
    return joined.select(
        *[F.col(f"_moved_{c}").alias(c) if c in columns else F.col(c) for c in kept]
    )
