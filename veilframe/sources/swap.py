"""Replacing a stored table without a moment in which its old rows are lost.

New rows are written beside the table; only when they are complete the old folder is set
aside and the new one takes its name. A write that fails midway leaves the old table as it
was. The two renames are metadata operations of the file system; a crash between them
leaves the old rows set aside, and `recover` (or `read_replaced`) puts them back. One writer
at a time. On stores without renames, where a rename copies, use catalog tables instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Hidden names in the table's own folder, so nobody who reads the folder sees them.
_NEW, _OLD = ".new-", ".old-"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration())


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _hidden(path: str, mark: str, ending: str) -> str:
    folder, _, name = path.rpartition("/")
    return f"{folder}/{mark}{name}-{ending}"


def _beside(spark: SparkSession, path: str, mark: str) -> list[str]:
    pattern = _path(spark, _hidden(path, mark, "?" * 32))
    found = _file_system(spark, path).globStatus(pattern)
    return sorted(s.getPath().toString() for s in found or [])


def _rename(spark: SparkSession, source: str, target: str) -> None:
    if not _file_system(spark, source).rename(_path(spark, source), _path(spark, target)):
        raise OSError(f"could not rename {source} to {target}")


def _restore(spark: SparkSession, path: str) -> bool:
    """Rows set aside take their place again if it is empty; whether any did."""
    old = _beside(spark, path, _OLD)
    if not old or _file_system(spark, path).exists(_path(spark, path)):
        return False
    _rename(spark, old[-1], path)
    return True


def recover(spark: SparkSession, path: str) -> bool:
    """Put the old rows back if a replacement ended between its renames; whether it had.

    What an unfinished replacement has left beside the table is deleted.
    """
    path = path.rstrip("/")
    system = _file_system(spark, path)
    restored = _restore(spark, path)
    for left in (*_beside(spark, path, _NEW), *_beside(spark, path, _OLD)):
        system.delete(_path(spark, left), True)
    return restored


def switch(spark: SparkSession, path: str, fresh: str) -> None:
    """Let the complete folder `fresh` take the place of the table at `path`."""
    system = _file_system(spark, path)
    aside = None
    if system.exists(_path(spark, path)):
        aside = _hidden(path, _OLD, uuid.uuid4().hex)
        _rename(spark, path, aside)
    _rename(spark, fresh, path)
    if aside is not None:
        system.delete(_path(spark, aside), True)


def replace_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Replace the Parquet table at `path` by `df`, which may be read from there itself."""
    spark, path = df.sparkSession, path.rstrip("/")
    fresh = _hidden(path, _NEW, uuid.uuid4().hex)
    df.write.partitionBy(*partition_by).parquet(fresh)
    _restore(spark, path)
    switch(spark, path, fresh)
    return spark.read.parquet(path)


def read_replaced(spark: SparkSession, path: str) -> DataFrame:
    """Read a table written by `replace_parquet`, recovering it first if need be."""
    if not _file_system(spark, path).exists(_path(spark, path)):
        recover(spark, path)
    return spark.read.parquet(path)


def replace_table(df: DataFrame, table: str) -> DataFrame:
    """Replace a catalog table: written under another name, then renamed.

    `table` may carry a database. `df` may read the table itself.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    fresh, aside = f"{table}__new_{mark}", f"{table}__old_{mark}"
    try:
        df.write.saveAsTable(fresh)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        raise
    existed = spark.catalog.tableExists(table)
    if existed:
        spark.sql(f"ALTER TABLE {table} RENAME TO {aside}")
    try:
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")
    except Exception:
        if existed:
            spark.sql(f"ALTER TABLE {aside} RENAME TO {table}")
        spark.sql(f"DROP TABLE {fresh}")
        raise
    if existed:
        spark.sql(f"DROP TABLE {aside}")
    return spark.table(table)
