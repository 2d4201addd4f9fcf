"""A surrogate mapping kept from run to run, extended without moving what it already holds.

The mapping lies in two folders of bucketed files, written once and only added to: `values`,
bucketed by (column, value), answers which surrogate a value has; `taken`, bucketed by
surrogate, answers whether one is in use. A run deals its distinct new cells into the same
buckets and joins them bucket by bucket, so the stored side is read but never shuffled.

Surrogates are entered in `taken` before `values`, each with its owner. A run that fails in
between, or midway through either, leaves entries that a later run finds to be its own: it
adds what is missing and gives the same surrogates. One writer at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.operators.surrogate import _cells, _surrogate, apply_mapping
from veilframe.session import stored_once
from veilframe.sources.swap import recover, switch

BUCKETS = 256
_NAMES = ("column_name", "original_value")
_COLUMNS = (*_NAMES, "surrogate_value")
_KEYS = {"values": _NAMES, "taken": ("surrogate_value",)}


@dataclass(frozen=True)
class SurrogateStore:
    """A stored mapping; `open_store` makes or finds it."""

    spark: SparkSession
    path: str
    buckets: int

    def _table(self, part: str) -> str:
        return f"veilframe_{part}_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"

    def _create(self, table: str, keys: Sequence[str], place: str) -> None:
        quoted = place.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} "
            f"({', '.join(f'{c} STRING' for c in _COLUMNS)}) USING parquet "
            f"CLUSTERED BY ({', '.join(keys)}) INTO {self.buckets} BUCKETS LOCATION '{quoted}'"
        )

    def _attach(self) -> None:
        for part, keys in _KEYS.items():
            recover(self.spark, f"{self.path}/{part}")
            self._create(self._table(part), keys, f"{self.path}/{part}")

    def mapping(self) -> DataFrame:
        """(column_name, original_value, surrogate_value) of every value seen so far."""
        self.spark.catalog.refreshTable(self._table("values"))
        return self.spark.table(self._table("values"))

    def _taken(self) -> DataFrame:
        self.spark.catalog.refreshTable(self._table("taken"))
        return self.spark.table(self._table("taken"))

    def _append(self, rows: DataFrame, part: str) -> None:
        dealt = rows.select(*_COLUMNS).repartition(self.buckets, *_KEYS[part])
        dealt.write.insertInto(self._table(part))

    def unseen(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """The distinct cells of `columns` without a surrogate yet; null cells need none."""
        cells = _cells(df, columns).distinct()
        return cells.join(self.mapping(), list(_NAMES), "left_anti")

    def add(self, df: DataFrame, columns: Sequence[str], key: str) -> int:
        """Give every new value of `columns` a surrogate; how many there were.

        Surrogates already given never change, whatever the key. A surrogate another value has
        is passed over for the next digest, in rounds, of which all but the first are nearly
        always empty. The key is a secret.
        """
        waiting = stored_once(self.unseen(df, columns), "surrogate-unseen")
        added = waiting.count()
        cell, attempt, left = F.concat_ws("|", *_NAMES), 1, added
        while left:
            digest = cell if attempt == 1 else F.concat_ws("|", cell, F.lit(str(attempt)))
            wanted = waiting.withColumn("surrogate_value", _surrogate(digest, key))
            first = W.partitionBy("surrogate_value").orderBy(*_NAMES)
            owners = self._taken().select(
                F.col("surrogate_value").alias("_value"),
                F.struct(*_NAMES).alias("_owner"),
            )
            own = F.col("_owner").isNull() | (F.col("_owner") == F.struct(*_NAMES))
            # A surrogate has one owner, so the join adds no rows.
            decided = stored_once(
                wanted.withColumn("_first", F.row_number().over(first) == 1)
                .join(owners, F.col("surrogate_value") == F.col("_value"), "left")
                .withColumn("given", own & (F.col("_first") | F.col("_owner").isNotNull()))
                .withColumn("entered", F.col("_owner").isNotNull())
                .select(*_COLUMNS, "given", "entered"),
                "surrogate-round",
            )
            given = decided.where("given")
            self._append(given.where("not entered"), "taken")
            self._append(given, "values")
            waiting = decided.where("not given").select(*_NAMES)
            left, attempt = waiting.count(), attempt + 1
        return added

    def compact(self) -> None:
        """Write each bucket as one file again, after many runs have added to it.

        The files are written beside the old ones and take their place when complete. A store
        must hold something.
        """
        for part, keys in _KEYS.items():
            fresh = f"{self.path}/.fresh-{part}-{uuid.uuid4().hex}"
            table = f"{self._table(part)}_fresh"
            # Read as plain files: a bucketed table would count as dealt already.
            rows = self.spark.read.parquet(f"{self.path}/{part}")
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            self._create(table, keys, fresh)
            rows.repartition(self.buckets, *keys).write.insertInto(table)
            self.spark.sql(f"DROP TABLE {table}")  # the files stay: the table is external
            switch(self.spark, f"{self.path}/{part}", fresh)
            self.spark.catalog.refreshTable(self._table(part))

    def apply(
        self, df: DataFrame, columns: Sequence[str], hot_keys: int | None = None
    ) -> DataFrame:
        """`df` with surrogates in place of the values of `columns`; see `apply_mapping`."""
        return apply_mapping(df, columns, self.mapping(), hot_keys)


def open_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> SurrogateStore:
    """The store at `path`, made empty with so many buckets if there is none.

    A store keeps the number of buckets it was made with; `buckets` is then ignored.
    """
    path = path.rstrip("/")
    layout = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/layout")
    system = layout.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(layout):
        buckets = spark.read.schema("buckets int").json(f"{path}/layout").first().buckets
    else:
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.json(f"{path}/layout")
    store = SurrogateStore(spark, path, buckets)
    store._attach()
    return store
