"""Tables laid out for key reads: clustered files whose row groups a filter can skip.

A Parquet row group carries the smallest and largest value of each column, and on request
a Bloom filter. Filters use both to skip groups unread, but only if equal and neighbouring
values lie together. Here rows are range-partitioned and sorted by the range keys, so a range
touches few files and groups; columns looked up by equality alone get Bloom filters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_FILE = 5_000_000
ROWS_PER_GROUP = 100_000
# A writer holds the statistics of all row groups of its file, and every reader parses them.
_GROUPS_PER_FILE = 1_000
# Bits per key of an interleaved order: 2^6 slices of each key.
_SLICE_BITS = 6
# Accuracy of the slices' borders: their ranks are off by 1/10,000 of the rows at most.
_ACCURACY = 10_000


def _sliced(value: Column, borders: Sequence, low: int = 0) -> Column:
    """How many borders the value reaches, found by halving; null reaches none."""
    if not borders:
        return F.lit(low)
    middle = len(borders) // 2
    above = _sliced(value, borders[middle + 1 :], low + middle + 1)
    return F.when(value >= F.lit(borders[middle]), above).otherwise(
        _sliced(value, borders[:middle], low)
    )


def _borders(df: DataFrame, keys: Sequence[str]) -> dict[str, list]:
    """Values that cut each key into slices of about equally many rows, in one pass."""
    shares = [i / (1 << _SLICE_BITS) for i in range(1, 1 << _SLICE_BITS)]
    row = df.agg(*[F.percentile_approx(k, shares, _ACCURACY).alias(k) for k in keys]).first()
    return {k: sorted(set(row[k] or [])) for k in keys}


def interleaved(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Add one number per row in which the keys' slices take turns bit by bit.

    Rows that are near in all keys get near numbers, so groups of rows sorted by it are
    narrow in every key. The slices follow the data's quantiles, so a skewed key is cut as
    evenly as an even one. Keys are numbers, dates or times.
    """
    if len(keys) * _SLICE_BITS > 62:
        raise ValueError("too many keys to interleave")
    borders = _borders(df, keys)
    slices = {f"{name}{i}": _sliced(F.col(k), borders[k]) for i, k in enumerate(keys)}
    order = F.lit(0).cast("bigint")
    for bit in range(_SLICE_BITS):
        for place, number in enumerate(slices):
            one = F.shiftright(F.col(number), bit).bitwiseAND(F.lit(1)).cast("bigint")
            order = order.bitwiseOR(F.shiftleft(one, bit * len(keys) + place))
    return df.withColumns(slices).withColumn(name, order).drop(*slices)


def write_clustered(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    lookups: Sequence[str] = (),
    interleave: bool = False,
    rows_per_file: int = ROWS_PER_FILE,
    rows_per_group: int = ROWS_PER_GROUP,
) -> DataFrame:
    """Write `df` clustered by `keys` to the new folder `path` and read it back.

    With `interleave` every key prunes alike; otherwise the first prunes most, as in a
    composite index. Columns in `lookups` get Bloom filters for equality. A value that fills
    several files is spread over them by the rest of its row, so no task gets more than its
    share. Null keys come first. The rows are counted first, to choose the number of files.
    A file has at most `rows_per_file` rows and about a thousand row groups, so what a task
    sorts and writes does not grow with the table.
    """
    if not keys:
        raise ValueError("name at least one key to cluster by")
    most = min(rows_per_file, rows_per_group * _GROUPS_PER_FILE)
    files = max(1, math.ceil(df.count() / most))
    order = list(keys)
    placed = df
    if interleave and len(keys) > 1:
        placed, order = interleaved(df, keys, "_order"), ["_order", *keys]
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rest = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    laid = placed.repartitionByRange(files, *order, rest).sortWithinPartitions(*order)
    writer = laid.select(*[F.col(f"`{c}`") for c in df.columns]).write.option("parquet.block.row.count.limit", rows_per_group)
    for column in lookups:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(
            f"parquet.bloom.filter.expected.ndv#{column}", rows_per_group
        )
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)
