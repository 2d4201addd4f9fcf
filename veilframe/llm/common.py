"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.session import stored_once

__all__ = ["held_out", "stored_once", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def held_out(ident: str, modulus: int, remainder: int):
    """Whether a row's id belongs to the fold whose labels may not be learnt; false for a null id."""
    fold = F.crc32(F.col(ident).cast("string").cast("binary")) % F.lit(modulus)
    return F.coalesce(fold == F.lit(remainder), F.lit(False))

