"""Session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


# Shuffled bytes one task should get.
_BYTES_PER_TASK = 128 << 20


def build_session(
    app: str = "veilframe",
    master: str | None = None,
    shuffle_bytes: int | None = None,
    shared_dir: str | None = None,
    **conf: str,
) -> SparkSession:
    """Session with adaptive execution on; `conf` keys use `__` for dots.

    `shuffle_bytes` is the size of the largest shuffle to expect, for instance the bytes of
    the columns a job moves. Spark starts with enough partitions for it and merges the
    small ones afterwards; its own default of 200 would spill at that size.
    `shared_dir` becomes `spark.checkpoint.dir`, the folder for written intermediates.
    """
    if shared_dir is not None:
        conf["spark__checkpoint__dir"] = shared_dir
    if shuffle_bytes is not None:
        partitions = max(200, -(-shuffle_bytes // _BYTES_PER_TASK))
        conf.setdefault("spark__sql__shuffle__partitions", str(partitions))
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir` of the session.

    A local session without the setting uses a folder in its warehouse. On a cluster the
    setting is required, since a folder of one machine would be lost with it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(
            "set spark.checkpoint.dir, or build_session(shared_dir=...), to a folder that all "
            "executors share"
        )
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediates"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/veilframe/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove_intermediates(spark: SparkSession) -> bool:
    """Delete what this application has written under `fresh_path`; whether there was any.

    For the end of a job: tables read from there can no longer be read afterwards.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored_once(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate that is read several times and go on from the files.

    It outlives the executors that made it, and nothing before it runs again.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
