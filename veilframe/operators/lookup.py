"""Left join to a table with one row per key, safe against hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds at least 1/HOT_KEYS of all rows, so there can be no
# more than HOT_KEYS of them: that bounds what is broadcast.
HOT_KEYS = 100_000


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    payload: str,
    weight: str,
    hot_keys: int | None = None,
) -> DataFrame:
    """Add `payload` of the matching `table` row, or NULL; null keys never match.

    `table` has unique keys and in `weight` the number of `rows` carrying the key.
    A key is hot if it holds at least 1/hot_keys (default 1/HOT_KEYS) of all rows. Hot
    keys are answered by a broadcast of at most `hot_keys` rows, in place: their rows are
    not shuffled at all, nor are those with a null key. Only the remaining rows go through
    a shuffled join, and there no key holds more than 1/hot_keys of them. `rows` is read
    twice for this, which for wide rows costs less than shuffling them.
    """
    bound = HOT_KEYS if hot_keys is None else hot_keys
    # The joins imply this filter; stated for all uses of the table, they share one plan
    # and so one shuffle.
    table = table.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    total = table.agg(F.sum(weight).alias("n")).scalar()
    is_hot = F.col(weight) * F.lit(bound) >= total
    hot = table.where(is_hot).select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys],
        F.col(payload).alias(payload),
        F.lit(True).alias("_is_hot"),
    )
    cold = table.where(~is_hot).select(*[F.col(k).alias(f"_cold_{k}") for k in keys], payload)
    columns = rows.columns
    marked = rows.join(
        F.broadcast(hot), [F.col(k) == F.col(f"_hot_{k}") for k in keys], "left"
    )
    in_place = reduce(or_, [F.col(k).isNull() for k in keys], F.col("_is_hot").isNotNull())
    answered = marked.where(in_place).select(*columns, payload)
    open_rows = marked.where(~in_place).select(*columns)
    looked_up = open_rows.join(
        cold, [F.col(k) == F.col(f"_cold_{k}") for k in keys], "left"
    ).select(*columns, payload)
    return answered.unionByName(looked_up)
