"""Synthetic scaling, generated tables, numbering, files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.catalog.base import (
    adult,
    healthcare,
    plain,
    register,
    sql_index,
    sql_normal,
    sql_pick,
    sql_uniform,
    table,
    with_adult,
    with_healthcare,
)
from veilframe.functions import fakes
from veilframe.operators import dp, synth
from veilframe.operators.rank import dense_ids
from veilframe.plans import report
from veilframe.sources import files, generators, schemas
from veilframe.session import fresh_path

SYNTH_KEY = "synth-key"
END = dt.date(2025, 11, 5)

# --- scaling ------------------------------------------------------------------------------------


def _base(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_size", "p_retailprice"
    )


_BASE = "base AS (SELECT p_partkey AS id, p_brand, p_type, p_size, p_retailprice FROM part)"


def _moved_number(column: str, integral: bool, cast: str | None = None) -> str:
    noise = sql_normal(SYNTH_KEY, column, "_row")
    moved = (
        f"least(greatest(CAST({column} AS DOUBLE) + {noise} * "
        f"((SELECT stddev_samp({column}) FROM base) * 0.05::DOUBLE), "
        f"(SELECT min({column}) FROM base)::DOUBLE), (SELECT max({column}) FROM base)::DOUBLE)"
    )
    if cast is not None:
        return f"CAST(CAST({moved} AS {cast}) AS DOUBLE)"
    return f"CAST({moved} AS INTEGER)" if integral else f"round({moved}, 4)"


def _replaced(column: str) -> str:
    order = sql_uniform(SYNTH_KEY, f"{column}.dictionary", "v")
    ident = f"coalesce(CAST({column} AS VARCHAR), chr(0))"
    distinct = f"(SELECT DISTINCT {column} AS x, {ident} AS v FROM base)"
    values = f"(SELECT list(x ORDER BY {order}, v) FROM {distinct})"
    size = f"(SELECT COUNT(*) FROM {distinct})"
    pick = sql_index(sql_uniform(SYNTH_KEY, column, "_row", 1), size)
    chance = sql_uniform(SYNTH_KEY, column, "_row")
    return f"CASE WHEN {chance} < 0.05::DOUBLE THEN ({values})[{pick}] ELSE {column} END"


def _perturbed(copies: str) -> str:
    return (
        f"copied AS (SELECT base.*, CAST(id AS VARCHAR) || ':' || CAST(c AS VARCHAR) AS _row "
        f"FROM base, range(1, {copies} + 1) t(c)), "
        f"perturbed AS (SELECT _row, {_replaced('p_brand')} AS p_brand, "
        f"{_replaced('p_type')} AS p_type, {_moved_number('p_size', True)} AS p_size, "
        f"{_moved_number('p_retailprice', False)} AS p_retailprice FROM copied)"
    )


@register(
    "synthetic_noise",
    f"WITH {_BASE}, {_perturbed('2')} "
    "SELECT _row AS row_id, p_brand, p_type, p_size, p_retailprice FROM perturbed",
)
def synthetic_noise(spark, sf_dir):
    base = _base(spark, sf_dir)
    moved = synth.perturb(synth.replicate(base, 2), base)
    return moved.select(
        F.col("_row").alias("row_id"), "p_brand", "p_type", "p_size",
        F.round("p_retailprice", 4).alias("p_retailprice"),
    )


_SAMPLE_DRAW = sql_uniform(SYNTH_KEY, "sample", "_row")


@register(
    "synthetic_scale",
    f"WITH {_BASE}, {_perturbed('3')}, ranked AS (SELECT *, "
    f"row_number() OVER (ORDER BY {_SAMPLE_DRAW}, _row) AS id FROM perturbed) "
    "SELECT id, p_brand, p_type, p_size, p_retailprice FROM ranked "
    "WHERE id <= (SELECT COUNT(*) * 5 // 2 FROM base)",
)
def synthetic_scale(spark, sf_dir):
    base = _base(spark, sf_dir)
    grown = synth.scale_rows(base, base.count() * 5 // 2)
    return grown.withColumn("p_retailprice", F.round("p_retailprice", 4))


@register(
    "synthetic_scale_down",
    f"WITH {_BASE}, ranked AS (SELECT * EXCLUDE (id), row_number() OVER (ORDER BY "
    f"{sql_uniform(SYNTH_KEY, 'sample', 'CAST(id AS VARCHAR)')}, CAST(id AS VARCHAR)) AS id "
    "FROM base) SELECT id, p_brand, p_type, p_size, p_retailprice FROM ranked "
    "WHERE id <= (SELECT COUNT(*) // 3 FROM base)",
)
def synthetic_scale_down(spark, sf_dir):
    base = _base(spark, sf_dir)
    return synth.scale_rows(base, base.count() // 3)


@register(
    "synthetic_noise_joined",
    f"WITH {_BASE}, {_perturbed('2')} "
    "SELECT _row AS row_id, p_brand, p_type, p_size, p_retailprice FROM perturbed",
)
def synthetic_noise_joined(spark, sf_dir):
    """The same cells are replaced by the same values when the values are joined."""
    base = _base(spark, sf_dir)
    moved = synth.perturb(synth.replicate(base, 2), base, array_values=3)
    return moved.select(
        F.col("_row").alias("row_id"), "p_brand", "p_type", "p_size",
        F.round("p_retailprice", 4).alias("p_retailprice"),
    )


def _scaled_people(columns: dict[str, str], source: str) -> str:
    """SQL for twice a person table: `columns` maps a column to its kind."""
    cells = []
    for name, kind in columns.items():
        if kind == "integer":
            cells.append(f"{_moved_number(name, True)} AS {name}")
        elif kind == "decimal":
            cells.append(f"{_moved_number(name, False, 'DECIMAL(10,2)')} AS {name}")
        else:
            cells.append(f"CAST({_replaced(name)} AS VARCHAR) AS {name}")
    return (
        f"base AS (SELECT id, {', '.join(columns)} FROM {source}), "
        "copied AS (SELECT base.*, CAST(id AS VARCHAR) || ':' || CAST(c AS VARCHAR) AS _row "
        f"FROM base, range(1, 3) t(c)), perturbed AS (SELECT _row, {', '.join(cells)} FROM copied), "
        f"ranked AS (SELECT *, row_number() OVER (ORDER BY {_SAMPLE_DRAW}, _row) AS id "
        "FROM perturbed) "
    )


# Kinds of the scaled columns of the person tables.
_ADULT_KINDS = {
    "age": "integer", "workclass": "text", "education": "text", "occupation": "text",
    "race": "text", "capital_gain": "integer", "hours_per_week": "integer", "income": "text",
}
_HEALTHCARE_KINDS = {
    "name": "text", "age": "integer", "medical_condition": "text", "date_of_admission": "text",
    "doctor": "text", "billing_amount": "decimal", "medication": "text",
}


@register(
    "synthetic_adult",
    with_adult(
        f"SELECT id, {', '.join(_ADULT_KINDS)} FROM ranked",
        _scaled_people(_ADULT_KINDS, "adult"),
    ),
)
def synthetic_adult(spark, sf_dir):
    """The census table at twice its size."""
    base = adult(spark, sf_dir).select("id", *_ADULT_KINDS)
    return synth.scale_rows(base, base.count() * 2)


@register(
    "synthetic_healthcare",
    with_healthcare(
        f"SELECT id, {', '.join(_HEALTHCARE_KINDS)} FROM ranked",
        _scaled_people(_HEALTHCARE_KINDS, "healthcare"),
    ),
)
def synthetic_healthcare(spark, sf_dir):
    """The hospital table at twice its size; names and doctors come by a join."""
    base = healthcare(spark, sf_dir).select("id", *_HEALTHCARE_KINDS)
    return plain(synth.scale_rows(base, base.count() * 2, array_values=50))


# --- generated tables, one row per given id -----------------------------------------------------------


def _g(label: str, ident: str, part: int = 0) -> str:
    return sql_uniform("gen-key", label, ident, part)


def _whole(label: str, ident: str, low: int, count: int, part: int = 0) -> str:
    return f"CAST({low - 1} + {sql_index(_g(label, ident, part), count)} AS INTEGER)"


@register(
    "gen_quasi_identifiers",
    "SELECT c_custkey AS user_id, "
    f"lpad(CAST({_whole('zip', 'c_custkey', 0, 100000)} AS VARCHAR), 5, '0') AS zip_code, "
    f"{_whole('birth', 'c_custkey', 1940, 65)} AS birth_year, "
    f"CASE WHEN {_g('gender', 'c_custkey')} < 0.49::DOUBLE THEN 'M' "
    f"WHEN {_g('gender', 'c_custkey')} < 0.98::DOUBLE THEN 'F' ELSE 'O' END AS gender, "
    f"'D' || CAST({_whole('diagnosis', 'c_custkey', 100, 899)} AS VARCHAR) AS diagnosis_code, "
    f"CAST(DATE '2025-11-05' - {_whole('visit', 'c_custkey', 0, 731)} AS VARCHAR) AS visit_date, "
    f"round(100.0::DOUBLE + {_g('value', 'c_custkey')} * 9900.0::DOUBLE, 6) AS sensitive_value "
    "FROM customer",
)
def gen_quasi_identifiers(spark, sf_dir):
    ids = table(spark, sf_dir, "customer")
    return plain(generators.quasi_identifiers(ids, "c_custkey", END), 6)


_CODE = "sha256('gen-key|uuid|' || CAST(c_custkey AS VARCHAR))"


@register(
    "gen_high_cardinality",
    f"SELECT substr({_CODE}, 1, 8) || '-' || substr({_CODE}, 9, 4) || '-4' || "
    f"substr({_CODE}, 14, 3) || '-8' || substr({_CODE}, 18, 3) || '-' || substr({_CODE}, 21, 12) "
    "AS uuid, "
    "CAST(TIMESTAMP '2025-11-05 12:00:00' - to_seconds("
    f"{_whole('time', 'c_custkey', 0, 730 * 86400 + 1)}) AS VARCHAR) AS timestamp, "
    f"lower({sql_pick(fakes.FIRST_NAMES, _g('email', 'c_custkey'))}) || '.' || "
    f"lower({sql_pick(fakes.LAST_NAMES, _g('email', 'c_custkey', 1))}) || "
    f"CAST({_whole('email', 'c_custkey', 0, 1000000, 2)} AS VARCHAR) || '@' || "
    f"{sql_pick(generators.MAIL_DOMAINS, _g('email', 'c_custkey', 3))} AS email, "
    f"CAST({_whole('ip', 'c_custkey', 1, 223, 0)} AS VARCHAR) || '.' || "
    f"CAST({_whole('ip', 'c_custkey', 0, 256, 1)} AS VARCHAR) || '.' || "
    f"CAST({_whole('ip', 'c_custkey', 0, 256, 2)} AS VARCHAR) || '.' || "
    f"CAST({_whole('ip', 'c_custkey', 0, 256, 3)} AS VARCHAR) AS ip_address, "
    f"'Mozilla/5.0 (' || {sql_pick(generators.PLATFORMS, _g('agent', 'c_custkey'))} || ') ' || "
    f"{sql_pick(generators.BROWSERS, _g('agent', 'c_custkey', 1))} AS user_agent, "
    "sha256('gen-key|session|' || CAST(c_custkey AS VARCHAR)) AS session_id, "
    f"{_whole('value', 'c_custkey', 1, 10000)} AS value FROM customer",
)
def gen_high_cardinality(spark, sf_dir):
    ids = table(spark, sf_dir, "customer")
    return plain(
        generators.high_cardinality(ids, "c_custkey", dt.datetime(2025, 11, 5, 12, 0, 0))
    )


@register(
    "dense_ids",
    "SELECT row_number() OVER (ORDER BY event_id * 7 + user_id % 7) AS id, "
    "event_id * 7 + user_id % 7 AS gappy, user_id FROM events",
)
def numbered_events(spark, sf_dir):
    """Ids without gaps for all rows, by a key with gaps."""
    events = table(spark, sf_dir, "events")
    gappy = (F.col("event_id") * 7 + F.col("user_id") % 7).alias("gappy")
    return dense_ids(events.select(gappy, "user_id"), "gappy", rows_per_bucket=1_000)


# --- files ----------------------------------------------------------------------------------------------

_ADULT_ROWS = with_adult("SELECT * FROM adult")


@register("csv_round_trip", _ADULT_ROWS)
def csv_round_trip(spark, sf_dir):
    """Write a CSV with header, load it by position into a replaced table, read that."""
    csv, stored = fresh_path(spark, "adult-csv"), fresh_path(spark, "adult-table")
    files.write_csv(adult(spark, sf_dir), csv)
    return files.load_csv(spark, csv, stored, schemas.ADULT)


@register(
    "csv_inferred",
    "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part",
)
def csv_inferred(spark, sf_dir):
    path = fresh_path(spark, "part-csv")
    files.write_csv(table(spark, sf_dir, "part"), path)
    return files.read_csv(spark, path).withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@register(
    "csv_headerless_numbered",
    with_adult(
        "SELECT row_number() OVER (ORDER BY id) AS line, age, occupation, income FROM adult"
    ),
)
def csv_headerless_numbered(spark, sf_dir):
    """Text without header and with a blank after each comma; lines get ids 1..N."""
    path = fresh_path(spark, "adult-data")
    # Files in the order of the old ids, so that each line's number is known.
    people = adult(spark, sf_dir).repartitionByRange(6, "id").sortWithinPartitions("id").select(
        schemas.ADULT_WITHOUT_ID.names
    )
    people.select(_line(people.columns, ", ").alias("value")).write.text(path)
    raw = files.read_csv(
        spark, path, schemas.ADULT_WITHOUT_ID, header=False, trim_leading=True
    )
    return files.number_lines(raw, "line").select("line", "age", "occupation", "income")


def _line(columns, separator):
    return F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def _loaded_in_part(spark, sf_dir):
    """(rows, quarantine) of a load in which three of fifty lines are broken, each in its way."""
    people = adult(spark, sf_dir)
    kind, names = F.col("id") % 50, people.columns
    line = (
        F.when(kind == 1, F.concat(F.lit("x"), _line(names, ",")))
        .when(kind == 2, _line(names[:-1], ","))
        .when(kind == 3, F.concat(_line(names, ","), F.lit(",more")))
        .otherwise(_line(names, ","))
    )
    source = fresh_path(spark, "adult-broken")
    people.select(line.alias("value")).write.text(source)
    aside = fresh_path(spark, "adult-quarantine")
    rows = files.load_csv(
        spark, source, fresh_path(spark, "adult-loaded"), schemas.ADULT,
        malformed="quarantine", quarantine_path=aside, header=False,
    )
    return rows, aside


@register("csv_quarantine", with_adult("SELECT * FROM adult WHERE id % 50 NOT IN (1, 2, 3)"))
def csv_quarantine(spark, sf_dir):
    """A load that sets lines aside which do not fit, and keeps the others whole."""
    return _loaded_in_part(spark, sf_dir)[0]


@register(
    "csv_quarantined_lines",
    with_adult(
        "SELECT CASE id % 50 WHEN 1 THEN 'value' WHEN 2 THEN 'short' ELSE 'surplus' END AS reason, "
        "COUNT(*) AS lines FROM adult WHERE id % 50 IN (1, 2, 3) GROUP BY ALL"
    ),
)
def csv_quarantined_lines(spark, sf_dir):
    """How many lines such a load sets aside, and why."""
    _, aside = _loaded_in_part(spark, sf_dir)
    return files.quarantined(spark, aside).groupBy("reason").agg(F.sum("lines").alias("lines"))


@register(
    "replaced_table",
    with_adult("SELECT * FROM adult WHERE age >= 30"),
)
def replaced_table(spark, sf_dir):
    """A stored table replaced by part of itself: it is read while its successor is written."""
    path = fresh_path(spark, "adult-replaced")
    people = files.write_parquet(adult(spark, sf_dir), path)
    return files.write_parquet(people.where("age >= 30"), path)


_RECORDS = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("runs", T.LongType()),
        T.StructField("total_users", T.LongType()),
    ]
)


@register(
    "json_round_trip",
    "SELECT event_type, COUNT(*) AS runs, CAST(SUM(user_id) AS BIGINT) AS total_users "
    "FROM events GROUP BY event_type",
)
def json_round_trip(spark, sf_dir):
    """Metric records to JSON under dated names; the latest one is read back."""
    records = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("user_id").alias("total_users")
    )
    folder = fresh_path(spark, "metrics")
    older = records.withColumn("runs", F.lit(-1).cast("bigint"))
    files.write_metrics(older, f"{folder}/summary_20251104_000000.json")
    files.write_metrics(records, f"{folder}/summary_20251105_155750.json")
    return files.read_latest_metrics(spark, f"{folder}/summary_*.json", _RECORDS)


@register(
    "metric_csv_round_trip",
    "SELECT event_type, COUNT(*) AS runs, CAST(SUM(user_id) AS BIGINT) AS total_users "
    "FROM events GROUP BY event_type",
)
def metric_csv_round_trip(spark, sf_dir):
    records = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("user_id").alias("total_users")
    )
    path = fresh_path(spark, "metrics-csv")
    files.write_metrics(records, path, "csv")
    return files.read_csv(spark, path, _RECORDS)


def _flatten_sql() -> str:
    from veilframe.catalog.privacy import _COUNT, _EPS

    return with_adult(
        "SELECT 'count_by_age' AS query, epsilon, "
        "round(avg(abs(cnt - cnt_noised) / cnt) * 100, 3) AS relative_error "
        "FROM noisy_count GROUP BY epsilon",
        _EPS,
        _COUNT,
    )


@register("metric_flatten", _flatten_sql())
def metric_flatten(spark, sf_dir):
    """Noisy-aggregate records written as JSON, read back, reduced to what a chart shows."""
    released = dp.noisy_count(adult(spark, sf_dir), key="dp-key")
    path = fresh_path(spark, "dp-results")
    files.write_metrics(dp.accuracy(released, dp.COUNT_QUERY, "cnt", "cnt_noised"), path)
    records = files.read_metrics(
        spark, path, "query string, epsilon double, mae double, relative_error double"
    )
    return plain(report.privacy_utility(records), 3)
