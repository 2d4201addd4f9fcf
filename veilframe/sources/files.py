"""Reading and writing tables and metric records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.sources.swap import replace_parquet, replace_table


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    header: bool = True,
    trim_leading: bool = False,
) -> DataFrame:
    """CSV scan. With a schema columns go by position; without one types are inferred,
    which reads the file an extra time."""
    reader = spark.read.option("header", header).option("ignoreLeadingWhiteSpace", trim_leading)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    # The header line is skipped; its names need not be the schema's.
    return reader.schema(schema).option("enforceSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line per part file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> DataFrame:
    """Replace the table at `path` and read it back; a failed write leaves the old rows."""
    return replace_parquet(df, path)


def save_table(df: DataFrame, table: str) -> DataFrame:
    """Replace a catalog table; a failed write leaves the old rows."""
    return replace_table(df, table)


_BAD_LINE = "_bad_line"
# A quoted field by the reader's rules: quotes inside are escaped by a backslash.
_QUOTED = r'"(?:[^"\\]|\\.)*"'


def read_csv_checked(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    header: bool = True,
    trim_leading: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): the lines that fit the schema, and those that do not.

    A line does not fit if it has too few or too many fields or one that its column's type
    cannot hold; such a line is no row, not even in part. `bad` has the file, the line as it is
    and the reason: `short`, `surplus` or `value`. Every line goes to exactly one of the two.
    Blank lines are neither. All columns are parsed, even if the caller reads few.
    """
    given = [f.name for f in schema.fields]
    named = T.StructType([*schema.fields, T.StructField(_BAD_LINE, T.StringType())])
    lines = (
        spark.read.option("header", header)
        .option("ignoreLeadingWhiteSpace", trim_leading)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD_LINE)
        .option("columnPruning", False)
        .schema(named)
        .csv(path)
    )
    unquoted = F.regexp_replace(_BAD_LINE, _QUOTED, "")
    fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1
    reason = (
        F.when(fields < len(given), "short").when(fields > len(given), "surplus").otherwise("value")
    )
    # Always true, but it names every column: only a value that is asked for is parsed, so
    # without it a line would be bad or not depending on the columns a caller reads.
    parsed = F.xxhash64(*[F.col(f"`{c}`") for c in given]).bitwiseOR(F.lit(1)) != 0
    bad = lines.where(F.col(_BAD_LINE).isNotNull() & parsed).select(
        F.col("_metadata.file_path").alias("file"),
        F.col(_BAD_LINE).alias("line"),
        reason.alias("reason"),
    )
    rows = lines.where(F.col(_BAD_LINE).isNull() & parsed)
    return rows.select(*[F.col(f"`{c}`") for c in given]), bad


def load_csv(
    spark: SparkSession,
    csv_path: str,
    table_path: str,
    schema: T.StructType,
    malformed: str = "strict",
    quarantine_path: str | None = None,
    header: bool = True,
) -> DataFrame:
    """Replace the table at `table_path` by the rows of CSV files.

    A line that does not fit the schema stops a `strict` load, and the old rows stay. A
    `quarantine` load replaces the table by the lines that fit and writes the others to
    `quarantine_path`, with their file and the reason. `null` keeps what can be read of a line
    and sets the rest to null.
    """
    if malformed == "null":
        return write_parquet(read_csv(spark, csv_path, schema, header), table_path)
    if malformed not in ("strict", "quarantine"):
        raise ValueError(f"unknown way with malformed lines: {malformed}")
    if malformed == "quarantine":
        if quarantine_path is None:
            raise ValueError("a quarantine load needs a quarantine_path")
        rows, bad = read_csv_checked(spark, csv_path, schema, header)
        write_parquet(bad, quarantine_path)
        return write_parquet(rows, table_path)
    checked = (
        spark.read.option("header", header)
        .option("enforceSchema", True)
        .option("mode", "FAILFAST")
        .option("columnPruning", False)
        .schema(schema)
        .csv(csv_path)
    )
    return write_parquet(checked, table_path)


def quarantined(spark: SparkSession, quarantine_path: str) -> DataFrame:
    """(file, reason, lines): how many lines of each file a load has set aside, and why."""
    return (
        spark.read.parquet(quarantine_path)
        .groupBy("file", "reason")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


# Splits whose first numbers are sent to every executor; more are joined by a shuffle.
_BROADCAST_SPLITS = 100_000


def number_lines(df: DataFrame, name: str = "id") -> DataFrame:
    """Ids 1..N for a DataFrame read straight from files, in the order of the files' names.

    Lines of a file keep their order. Spark reads a file in splits and numbers the lines each
    task reads; per split, the first such number and the lines are counted, splits are put in
    order by file name and offset, and their sizes added up. That table has a row per split; no
    line is moved unless it is too large to broadcast. Only valid on a plain scan, whose splits
    are the same each time they are read.
    """
    line = F.monotonically_increasing_id()
    place = [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_offset"),
    ]
    splits = (
        df.select(*place, line.alias("_line"))
        .groupBy("_file", "_offset")
        .agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    )
    earlier = W.orderBy("_file", "_offset").rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select(
        F.col("_file").alias("_of_file"),
        F.col("_offset").alias("_of_offset"),
        (F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    if splits.count() <= _BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    placed = df.select(*[F.col(f"`{c}`") for c in df.columns], *place, line.alias("_line"))
    same = (F.col("_file") == F.col("_of_file")) & (F.col("_offset") == F.col("_of_offset"))
    return placed.join(starts, same).select(
        (F.col("_line") + F.col("_shift") + 1).alias(name), *[F.col(f"`{c}`") for c in df.columns]
    )


def write_metrics(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Metric records as JSON or CSV files in the folder `path`."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown metric format: {fmt}")


def read_metrics(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    one_document: bool = False,
) -> DataFrame:
    """JSON records, one per line, or one array or object per file (`one_document`)."""
    reader = spark.read.option("multiLine", one_document)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def latest_path(spark: SparkSession, pattern: str) -> str:
    """The last file or folder by name that matches; contents are not read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(status.getPath().toString() for status in found or [])
    if not names:
        raise FileNotFoundError(pattern)
    return names[-1]


def read_latest_metrics(
    spark: SparkSession,
    pattern: str,
    schema: T.StructType | str | None = None,
    one_document: bool = False,
) -> DataFrame:
    """Records of the newest file or folder, taking names to sort by time."""
    return read_metrics(spark, latest_path(spark, pattern), schema, one_document)
