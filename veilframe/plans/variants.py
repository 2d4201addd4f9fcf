"""The six masked variants of one table that are compared with each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from veilframe.operators.rank import exact_sample
from veilframe.operators.shuffle import shuffle_columns
from veilframe.plans import policy
from veilframe.session import stored_once

POLICIES = {
    "hash": policy.ADULT_HASH,
    "partial": policy.ADULT_PARTIAL,
    "fake": policy.ADULT_FAKE,
    "noise": policy.ADULT_NOISE,
    "generalize": policy.ADULT_GENERALIZE,
}
VARIANTS = ("hash", "partial", "shuffle", "fake", "noise", "generalize")
SHUFFLED = ("occupation", "native_country")
# Fixed value: rows of the compared sample.
SAMPLE_ROWS = 50_000


def sampled(df: DataFrame, rows: int = SAMPLE_ROWS, key: str = "variant-key") -> DataFrame:
    """The rows all variants are made of."""
    return exact_sample(df, "id", rows, key)


def masking_variant(
    df: DataFrame, name: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """One masked table with the columns of `df`, or only those of `columns`.

    Columns that are not wanted are not masked, in particular not shuffled.
    """
    if name == "shuffle":
        return shuffle_columns(df, SHUFFLED, wanted=columns)
    masked = POLICIES[name].apply(df)
    return masked if columns is None else masked.select(*columns)


def masking_variants(
    df: DataFrame, columns: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """Variant name -> masked table, for all six. Nothing runs yet."""
    return {name: masking_variant(df, name, columns) for name in VARIANTS}


def sampled_variants(
    df: DataFrame, rows: int = SAMPLE_ROWS, key: str = "variant-key"
) -> dict[str, DataFrame]:
    """The six variants of one sample, which is drawn once and stored."""
    return masking_variants(stored_once(sampled(df, rows, key), "variant-sample"))
