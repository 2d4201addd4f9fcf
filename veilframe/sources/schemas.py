"""Schemas of the two person tables and their loaders' variants."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "decimal(10,2)": T.DecimalType(10, 2),
    "decimal(12,2)": T.DecimalType(12, 2),
}


def _schema(columns: str) -> T.StructType:
    """`name type, name type, ...`; unlike a DDL string it needs no session."""
    pairs = [c.split(" ") for c in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Column names and order of the source files.
ADULT = _schema(
    "id bigint, age int, workclass string, fnlwgt int, education string, education_num int, "
    "marital_status string, occupation string, relationship string, race string, sex string, "
    "capital_gain int, capital_loss int, hours_per_week int, native_country string, income string"
)

# The public census file has no id and no header line.
ADULT_WITHOUT_ID = T.StructType(ADULT.fields[1:])

HEALTHCARE = _schema(
    "id bigint, name string, age int, gender string, blood_type string, "
    "medical_condition string, date_of_admission date, doctor string, hospital string, "
    "insurance_provider string, billing_amount decimal(10,2), room_number string, "
    "admission_type string, discharge_date date, medication string, test_results string"
)

HEALTHCARE_VARIANT = _schema(
    "patient_name string, age int, gender string, blood_type string, "
    "medical_condition string, date_of_admission date, doctor string, hospital string, "
    "insurance_provider string, billing_amount decimal(12,2), room_number int, "
    "admission_type string, discharge_date date, medication string, test_results string"
)

SURROGATE_MAPPING = _schema(
    "column_name string, original_value string, surrogate_value string"
)
