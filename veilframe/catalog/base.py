"""Registry of queries, the person tables made from the given ones, and SQL building blocks.

Every query has a Spark side and, beside it, the SQL another engine checks it with.
Results hold only integers, doubles, text and booleans: dates and decimals are
turned into text and doubles at the very end, so that both engines print them alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import fakes
from veilframe.functions.taxonomy import Taxonomy

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under `name` with its checking SQL."""

    def keep(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(run, sql)
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Dates and times as text, decimals as doubles; doubles rounded if asked."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        if digits is not None and isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits)
        out.append(c.alias(f.name))
    return df.select(*out)


# --- person tables -----------------------------------------------------------------------

# The categories of the public census and hospital tables.
WORKCLASS = (
    "Private", "Self-emp-not-inc", "Self-emp-inc", "Federal-gov", "Local-gov", "State-gov",
    "Without-pay", "?",
)
EDUCATION = (
    "Preschool", "1st-4th", "5th-6th", "7th-8th", "9th", "10th", "11th", "12th", "HS-grad",
    "Some-college", "Assoc-voc", "Assoc-acdm", "Bachelors", "Masters", "Prof-school", "Doctorate",
)
MARITAL = (
    "Married-civ-spouse", "Divorced", "Never-married", "Separated", "Widowed",
    "Married-spouse-absent", "Married-AF-spouse",
)
OCCUPATION = (
    "Tech-support", "Craft-repair", "Other-service", "Sales", "Exec-managerial",
    "Prof-specialty", "Handlers-cleaners", "Machine-op-inspct", "Adm-clerical",
    "Farming-fishing", "Transport-moving", "Priv-house-serv", "Protective-serv",
    "Armed-Forces", "?", None,
)
RELATIONSHIP = (
    "Wife", "Own-child", "Husband", "Not-in-family", "Other-relative", "Unmarried",
)
RACE = ("White", "Black", "Asian-Pac-Islander", "Amer-Indian-Eskimo", "Other")
COUNTRY = (
    "United-States", "United-States", "United-States", "United-States", "United-States",
    "Mexico", "Philippines", "Germany", "?", None,
)
BLOOD = ("A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-")
CONDITION = ("Cancer", "Diabetes", "Obesity", "Asthma", "Hypertension", "Arthritis")
INSURER = ("Aetna", "Blue Cross", "Cigna", "Medicare", "UnitedHealthcare")
ADMISSION = ("Elective", "Emergency", "Urgent")
MEDICATION = ("Aspirin", "Ibuprofen", "Lipitor", "Paracetamol", "Penicillin", None)
TEST_RESULT = ("Normal", "Abnormal", "Inconclusive")


def _pick(values: Sequence[str | None], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def adult(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The census table's columns, one person per order."""
    o = table(spark, sf_dir, "orders")
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    education = (cust + key) % 16
    return o.select(
        key.alias("id"),
        (day % 74 + 17).cast("int").alias("age"),
        _pick(WORKCLASS, cust % 8).alias("workclass"),
        F.floor(price).cast("int").alias("fnlwgt"),
        _pick(EDUCATION, education).alias("education"),
        (education + 1).cast("int").alias("education_num"),
        _pick(MARITAL, cust % 7).alias("marital_status"),
        _pick(OCCUPATION, (key * 7 + cust) % 16).alias("occupation"),
        _pick(RELATIONSHIP, key % 6).alias("relationship"),
        F.when(key % 211 != 0, _pick(RACE, cust % 5)).alias("race"),
        F.when(F.col("o_orderstatus") == "F", "Female").otherwise("Male").alias("sex"),
        F.when(key % 10 < 7, 0).otherwise(F.floor(price / 5).cast("int")).alias("capital_gain"),
        F.when(key % 97 != 0, F.when(key % 20 == 1, F.floor(price / 100).cast("int")).otherwise(0))
        .alias("capital_loss"),
        (day % 99 + 1).cast("int").alias("hours_per_week"),
        _pick(COUNTRY, cust % 10).alias("native_country"),
        F.when(price > 250000, ">50K").otherwise("<=50K").alias("income"),
    )


def healthcare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hospital table's columns, one admission per event."""
    e = table(spark, sf_dir, "events")
    key, user = F.col("event_id"), F.col("user_id")
    admitted = F.col("ts").cast("date")
    return e.select(
        key.alias("id"),
        F.concat(
            _pick(fakes.FIRST_NAMES, user % 20), F.lit(" "), _pick(fakes.LAST_NAMES, key % 20)
        ).alias("name"),
        ((key * 13 + user) % 73 + 18).cast("int").alias("age"),
        F.when(user % 2 == 0, "Female").otherwise("Male").alias("gender"),
        _pick(BLOOD, user % 8).alias("blood_type"),
        _pick(CONDITION, (key + user) % 6).alias("medical_condition"),
        admitted.alias("date_of_admission"),
        F.concat(F.lit("Dr. "), _pick(fakes.LAST_NAMES, user % 20), F.lit(" "), key % 40).alias(
            "doctor"
        ),
        F.concat(F.lit("Hospital "), F.col("event_type")).alias("hospital"),
        _pick(INSURER, user % 5).alias("insurance_provider"),
        (F.col("value") * 100).cast("decimal(10,2)").alias("billing_amount"),
        (user + 100).cast("string").alias("room_number"),
        _pick(ADMISSION, key % 3).alias("admission_type"),
        F.date_add(admitted, (key % 30 + 1).cast("int")).alias("discharge_date"),
        _pick(MEDICATION, (key + user) % 6).alias("medication"),
        _pick(TEST_RESULT, user % 3).alias("test_results"),
    )


# --- the same in SQL ------------------------------------------------------------------------


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_list(values: Sequence[str | None]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def _at(values: Sequence[str | None], index: str) -> str:
    return f"({sql_list(values)})[CAST({index} AS INTEGER) + 1]"


_DAY = "date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))"

ADULT_SQL = f"""
  SELECT o_orderkey AS id,
         CAST({_DAY} % 74 + 17 AS INTEGER) AS age,
         {_at(WORKCLASS, 'o_custkey % 8')} AS workclass,
         CAST(floor(o_totalprice) AS INTEGER) AS fnlwgt,
         {_at(EDUCATION, '(o_custkey + o_orderkey) % 16')} AS education,
         CAST((o_custkey + o_orderkey) % 16 + 1 AS INTEGER) AS education_num,
         {_at(MARITAL, 'o_custkey % 7')} AS marital_status,
         {_at(OCCUPATION, '(o_orderkey * 7 + o_custkey) % 16')} AS occupation,
         {_at(RELATIONSHIP, 'o_orderkey % 6')} AS relationship,
         CASE WHEN o_orderkey % 211 <> 0 THEN {_at(RACE, 'o_custkey % 5')} END AS race,
         CASE WHEN o_orderstatus = 'F' THEN 'Female' ELSE 'Male' END AS sex,
         CASE WHEN o_orderkey % 10 < 7 THEN 0
              ELSE CAST(floor(o_totalprice / 5) AS INTEGER) END AS capital_gain,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL
              WHEN o_orderkey % 20 = 1 THEN CAST(floor(o_totalprice / 100) AS INTEGER)
              ELSE 0 END AS capital_loss,
         CAST({_DAY} % 99 + 1 AS INTEGER) AS hours_per_week,
         {_at(COUNTRY, 'o_custkey % 10')} AS native_country,
         CASE WHEN o_totalprice > 250000 THEN '>50K' ELSE '<=50K' END AS income
  FROM orders"""

HEALTHCARE_SQL = f"""
  SELECT event_id AS id,
         {_at(fakes.FIRST_NAMES, 'user_id % 20')} || ' ' ||
           {_at(fakes.LAST_NAMES, 'event_id % 20')} AS name,
         CAST((event_id * 13 + user_id) % 73 + 18 AS INTEGER) AS age,
         CASE WHEN user_id % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
         {_at(BLOOD, 'user_id % 8')} AS blood_type,
         {_at(CONDITION, '(event_id + user_id) % 6')} AS medical_condition,
         CAST(ts AS DATE) AS date_of_admission,
         'Dr. ' || {_at(fakes.LAST_NAMES, 'user_id % 20')} || ' ' ||
           CAST(event_id % 40 AS VARCHAR) AS doctor,
         'Hospital ' || event_type AS hospital,
         {_at(INSURER, 'user_id % 5')} AS insurance_provider,
         CAST(value * 100 AS DECIMAL(10,2)) AS billing_amount,
         CAST(user_id + 100 AS VARCHAR) AS room_number,
         {_at(ADMISSION, 'event_id % 3')} AS admission_type,
         CAST(CAST(ts AS DATE) + CAST(event_id % 30 + 1 AS INTEGER) AS DATE) AS discharge_date,
         {_at(MEDICATION, '(event_id + user_id) % 6')} AS medication,
         {_at(TEST_RESULT, 'user_id % 3')} AS test_results
  FROM events"""

ADULT_COLUMNS = (
    "id", "age", "workclass", "fnlwgt", "education", "education_num", "marital_status",
    "occupation", "relationship", "race", "sex", "capital_gain", "capital_loss",
    "hours_per_week", "native_country", "income",
)
HEALTHCARE_COLUMNS = (
    "id", "name", "age", "gender", "blood_type", "medical_condition", "date_of_admission",
    "doctor", "hospital", "insurance_provider", "billing_amount", "room_number",
    "admission_type", "discharge_date", "medication", "test_results",
)
# How a healthcare column prints in a result.
HEALTHCARE_OUT = {
    "date_of_admission": "CAST(date_of_admission AS VARCHAR)",
    "discharge_date": "CAST(discharge_date AS VARCHAR)",
    "billing_amount": "CAST(billing_amount AS DOUBLE)",
}


def with_adult(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([f"adult AS ({ADULT_SQL})", *more]) + "\n" + body


def with_healthcare(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([f"healthcare AS ({HEALTHCARE_SQL})", *more]) + "\n" + body


def projection(columns: Sequence[str], changed: dict[str, str]) -> str:
    """Select list in table order with some columns replaced by expressions."""
    return ",\n         ".join(f"{changed[c]} AS {c}" if c in changed else c for c in columns)


# --- masks in SQL ---------------------------------------------------------------------------


def sql_uniform(key: str, label: str, ident: str, part: int = 0) -> str:
    seed = f"sha256({text(f'{key}|{label}|')} || CAST({ident} AS VARCHAR))"
    digits = f"'0x' || substr({seed}, {1 + 13 * part}, 13)"
    return f"(CAST(CAST({digits} AS BIGINT) AS DOUBLE) / 4503599627370496::DOUBLE)"


def sql_index(draw: str, size: int | str) -> str:
    return f"LEAST(CAST(floor({draw} * {size}) AS INTEGER) + 1, CAST({size} AS INTEGER))"


def sql_pick(values: Sequence[str], draw: str) -> str:
    return f"({sql_list(values)})[{sql_index(draw, len(values))}]"


def sql_laplace(draw: str, scale: str) -> str:
    centred = f"({draw} - 0.5::DOUBLE)"
    tail = f"greatest(1.0::DOUBLE - 2.0::DOUBLE * abs({centred}), 1e-15::DOUBLE)"
    return f"({scale} * sign({centred}) * ln({tail}))"


def sql_normal(key: str, label: str, ident: str) -> str:
    radius = f"greatest({sql_uniform(key, label, ident)}, 1e-15::DOUBLE)"
    angle = sql_uniform(key, label, ident, 1)
    return f"(sqrt(-2.0::DOUBLE * ln({radius})) * cos(2.0::DOUBLE * pi() * {angle}))"


def sql_hmac(value: str, key: str) -> str:
    secret = key.encode()
    if len(secret) > 64:
        secret = hashlib.sha256(secret).digest()
    secret = secret.ljust(64, b"\0")
    inner = "".join(f"\\x{b ^ 0x36:02X}" for b in secret)
    outer = "".join(f"\\x{b ^ 0x5C:02X}" for b in secret)
    return (
        f"sha256('{outer}'::BLOB || "
        f"unhex(sha256('{inner}'::BLOB || encode(CAST({value} AS VARCHAR)))))"
    )


def sql_taxonomy(tree: Taxonomy, value: str) -> str:
    source = f"trim({value})" if tree.trim else value
    cases = " ".join(
        f"WHEN {source} IN ({', '.join(text(m) for m in members)}) THEN {text(label)}"
        for label, members in tree.groups.items()
    )
    rest = source if tree.default is None else text(tree.default)
    if not tree.null_is_default:
        cases += f" WHEN {source} IS NULL THEN NULL"
    return f"CASE {cases} ELSE {rest} END"


def sql_company(key: str, column: str, ident: str) -> str:
    return (
        sql_pick(fakes.COMPANY_WORDS, sql_uniform(key, column, ident))
        + " || ' ' || "
        + sql_pick(fakes.COMPANY_FORMS, sql_uniform(key, column, ident, 1))
    )


def sql_full_name(key: str, column: str, ident: str) -> str:
    return (
        sql_pick(fakes.FIRST_NAMES, sql_uniform(key, column, ident))
        + " || ' ' || "
        + sql_pick(fakes.LAST_NAMES, sql_uniform(key, column, ident, 1))
    )
