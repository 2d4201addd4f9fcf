"""Edge values of the row-local masks."""

import hashlib
import hmac as std_hmac
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import masks, prf
from veilframe.functions.taxonomy import (
    COUNTRY_US_OR_OTHER, EDUCATION_LEVEL, KANON_EDUCATION, OCCUPATION_CLASS, VIEW_EDUCATION,
    generalize_by_table,
)


def one(spark, values, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_bucket_truncates_and_floor_bucket_floors(spark):
    values = [-7, -1, 0, 4, 5, 37, None]
    assert one(spark, values, "int", lambda c: masks.bucket(c, 5)) == [-5, 0, 0, 0, 5, 35, None]
    assert one(spark, values, "int", lambda c: masks.floor_bucket(c, 5)) == [
        -10, -5, 0, 0, 5, 35, None,
    ]


@pytest.mark.parametrize("low,high", [(25, 45), (-12, -3), (-3, 7), (1, 4), (0, 0), (-5, -5)])
def test_bucket_between_equals_filter_on_masked_value(spark, low, high):
    df = spark.range(-60, 61).select(F.col("id").cast("int").alias("v"))
    masked = df.where(masks.bucket(F.col("v"), 5).between(low, high))
    raw = df.where(masks.bucket_between(F.col("v"), 5, low, high))
    assert {r.v for r in masked.collect()} == {r.v for r in raw.collect()}


def test_round_to_step_rounds_half_away_from_zero(spark):
    values = [Decimal(v) for v in ("50.00", "150.00", "249.99", "250.00", "-50.00")] + [None]
    got = one(spark, values, "decimal(10,2)", lambda c: masks.round_to_step(c, 100))
    assert got == [100, 200, 200, 300, -100, None]


def test_truncate_to_step_is_no_rounding(spark):
    assert one(spark, [999, 1999, -1999, None], "int", lambda c: masks.truncate_to_step(c, 1000)) == [
        0, 1000, -1000, None,
    ]


def test_partial(spark):
    values = ["Sales", "S", "", "é€漢字", "?", None]
    assert one(spark, values, "string", lambda c: masks.partial(c, 3)) == [
        "Sal***", "S***", "***", "é€漢***", "?***", None,
    ]
    assert one(spark, values, "string", lambda c: masks.partial(c, 2, keep=("?",))) == [
        "Sa***", "S***", "***", "é€***", "?", None,
    ]


def test_suppress_keeps_the_type(spark):
    df = spark.range(1).select(masks.suppress(T.DecimalType(10, 2)).alias("x"))
    assert df.schema["x"].dataType == T.DecimalType(10, 2)
    assert df.first()["x"] is None


@pytest.mark.parametrize("key", ["k", "secret_key_123", "x" * 64, "y" * 65, "schlüssel"])
def test_hmac_equals_the_standard_library(spark, key):
    values = ["", "a", "naïve", "x" * 200]
    want = [std_hmac.new(key.encode(), v.encode(), "sha256").hexdigest() for v in values] + [None]
    assert one(spark, [*values, None], "string", lambda c: masks.hmac_sha256_hex(c, key)) == want


def fpe(value: str, key: str) -> str:
    code = std_hmac.new(key.encode(), value.encode(), "sha256").digest()
    for block in range(1, (len(value) - 1) // 32 + 1):
        code += std_hmac.new(key.encode(), f"{value}|{block}".encode(), "sha256").digest()
    return "".join(masks.FPE_ALPHABET[code[i] % 36] for i in range(len(value)))


def test_length_preserving(spark):
    values = ["", "a", "Müller", "x" * 32, "y" * 33, "z" * 100, None]
    got = one(spark, values, "string", masks.length_preserving)
    assert got == [None if v is None else fpe(v, masks.FPE_KEY) for v in values]


def test_length_preserving_digests_a_block_once(spark):
    values = spark.createDataFrame([("y" * 70,)], "x string")
    masked = values.select(masks.length_preserving(F.col("x")).alias("x"))
    # Two digests for the first block, two in the lambda for the others, none per character.
    tree = masked._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("sha2(") == 4 and tree.count("lambdafunction(") == 1
    every = [chr(i) * n for i in (33, 233, 0x4E2D, 0x1F600) for n in (1, 31, 32, 33, 64, 65, 97)]
    want = [fpe(v, "k") for v in every]
    assert one(spark, every, "string", lambda c: masks.length_preserving(c, "k")) == want


def test_sha256_of_a_number_is_of_its_text(spark):
    got = one(spark, [42, None], "int", masks.sha256_hex)
    assert got == [hashlib.sha256(b"42").hexdigest(), None]


def test_noise_clamps_rounds_half_even_and_turns_null_to_floor(spark):
    half = F.lit(0.75)
    assert one(spark, [10, 30, None], "int", lambda c: masks.proportional_noise(c, half, 0.2)) == [
        10, 32, 0,
    ]
    assert one(spark, [1, 50, None], "int", lambda c: masks.additive_noise(c, F.lit(0.0), 10)) == [
        1, 45, 1,
    ]


def test_ratio_noise_keeps_type_and_null(spark):
    kind = T.DecimalType(10, 2)
    got = one(
        spark, [Decimal("100.00"), None], "decimal(10,2)",
        lambda c: masks.ratio_noise(c, F.lit(1.0), 0.15, kind),
    )
    assert got == [Decimal("115.00"), None]


def test_taxonomies_on_null_unknown_and_blanks(spark):
    values = ["7th-8th", " HS-grad ", "PhD", None]
    assert one(spark, values, "string", KANON_EDUCATION.column) == [
        "Middle", "High-School", "Other", None,
    ]
    assert one(spark, values, "string", EDUCATION_LEVEL.column) == [
        "Primary", "Other", "Other", "Other",
    ]
    assert one(spark, values, "string", VIEW_EDUCATION.column) == [
        "Some-School", " HS-grad ", "PhD", None,
    ]
    assert one(spark, ["?", None], "string", OCCUPATION_CLASS.column) == ["Unknown", "Unknown"]
    assert one(spark, ["United-States", None], "string", COUNTRY_US_OR_OTHER.column) == [
        "United-States", "Other",
    ]


def test_taxonomy_table_keeps_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    tree = spark.createDataFrame([("a", "A")], "value string, label string")
    got = generalize_by_table(df, "v", tree, None).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "A"), (2, "b"), (3, None)]


def test_draws_do_not_depend_on_partitioning(spark):
    draw = prf.uniform("k", "c", F.col("id")).alias("u")
    a = {tuple(r) for r in spark.range(0, 500, 1, 1).select("id", draw).collect()}
    b = {tuple(r) for r in spark.range(0, 500, 1, 7).select("id", draw).collect()}
    assert a == b
    assert len({u for _, u in a}) == 500


def test_parts_of_a_digest_differ(spark):
    with pytest.raises(ValueError):
        prf.uniform("k", "c", F.lit(1), prf.PARTS)
    row = spark.range(1).select(*[prf.uniform("k", "c", F.col("id"), p) for p in range(4)]).first()
    assert len(set(row)) == 4


def test_laplace_and_normal_have_the_right_moments(spark):
    lap = prf.laplace("k", "l", F.col("id"), 3.0)
    nor = prf.normal("k", "n", F.col("id"))
    row = spark.range(40_000).select(
        F.avg(lap), F.avg(F.abs(lap)), F.avg(nor), F.stddev_samp(nor)
    ).first()
    assert abs(row[0]) < 0.1 and abs(row[1] - 3.0) < 0.1
    assert abs(row[2]) < 0.02 and abs(row[3] - 1.0) < 0.02


def test_laplace_is_finite_at_the_edge(spark):
    row = spark.range(1).select(
        F.log(F.greatest(F.lit(1.0) - F.lit(2.0) * F.abs(F.lit(-0.5)), F.lit(1e-15)))
    ).first()
    assert row[0] is not None


def test_random_int_reaches_both_ends(spark):
    got = one(spark, [0.0, 0.999999999999], "double", lambda c: masks.random_int(c, 18, 90))
    assert got == [18, 90]
    assert one(spark, [0.0, 1.0], "double", lambda c: prf.pick(("a", "b"), c)) == ["a", "b"]
