"""Policies, workloads, scaling, generators, reports, files."""

import datetime as dt
import json
import uuid
from decimal import Decimal
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from veilframe.operators import kanon, sketches, synth
from veilframe.plans import policy, report, workloads
from veilframe.plans.variants import VARIANTS, masking_variants, sampled
from veilframe.session import fresh_path, remove_intermediates, shared_dir
from veilframe.sources import files, generators, schemas, swap

ADULT_ROWS = [
    (1, 37, "Private", 100, "7th-8th", 4, "Divorced", "Sales", "Wife", "White", "Female", 2500,
     0, 40, "United-States", ">50K"),
    (2, -7, "?", None, "HS-grad", 9, "Divorced", "?", "Wife", None, "Male", None, 999, 1,
     "?", "<=50K"),
    (3, 90, None, 7, "Doctorate", 16, "Divorced", None, "Wife", "Black", "Male", 0, None, 99,
     None, "<=50K"),
]


@pytest.fixture(scope="module")
def adult(spark):
    return spark.createDataFrame(ADULT_ROWS, schemas.ADULT)


@pytest.fixture(scope="module")
def patients(spark):
    rows = [
        (1, "Al Bo", 44, "Male", "A+", "Asthma", dt.date(2024, 1, 1), "Dr. X", "H", "I",
         Decimal("250.00"), "12", "Urgent", dt.date(2024, 1, 3), "Aspirin", "Normal"),
        (2, None, None, None, None, None, None, None, None, None, None, None, None, None, None,
         None),
    ]
    return spark.createDataFrame(rows, schemas.HEALTHCARE)


def test_adult_view(adult):
    rows = {r.id: r for r in policy.ADULT_VIEW.apply(adult).collect()}
    assert (rows[1].age, rows[1].education, rows[1].occupation, rows[1].native_country) == (
        35, "Some-School", "Sal***", "United-States",
    )
    assert (rows[2].age, rows[2].fnlwgt, rows[2].occupation, rows[2].native_country) == (
        -5, None, "?***", "Other",
    )
    assert (rows[3].education, rows[3].occupation, rows[3].native_country) == (
        "Doctorate", None, "Other",
    )


def test_healthcare_view_and_rules(patients):
    view = {r.id: r for r in policy.HEALTHCARE_VIEW.apply(patients).collect()}
    assert (view[1].name, view[1].age, view[1].billing_amount, view[1].room_number) == (
        "Al***", 40, 300, None,
    )
    assert view[2].name is None and view[2].billing_amount is None
    masked = policy.HEALTHCARE_RULES.apply(patients)
    assert masked.schema["billing_amount"].dataType == schemas.HEALTHCARE["billing_amount"].dataType
    row = masked.where("id = 1").first()
    assert 18 <= row.age <= 90 and Decimal("212.50") <= row.billing_amount <= Decimal("287.50")


def test_roles_see_different_tables_and_filters_act_on_masks(adult):
    assert policy.ADULT_RULES.read(adult, "analyst") is adult
    seen = policy.ADULT_RULES.read(adult, "masked_user")
    assert seen.columns == adult.columns
    assert seen.where("fnlwgt is not null").count() == 0
    assert seen.where("age < 18").count() == 0 and adult.where("age < 18").count() == 1
    assert seen.collect() == policy.ADULT_RULES.read(adult, "masked_user").collect()


def test_policy_rejects_unknown_columns(adult):
    with pytest.raises(ValueError, match="occupation"):
        policy.ADULT_VIEW.apply(adult.drop("occupation"))


def test_stored_copy_equals_the_view(spark, adult):
    stored = policy.ADULT_VIEW.store(adult, fresh_path(spark, "t"))
    assert sorted(map(tuple, stored.collect()), key=str) == sorted(
        map(tuple, policy.ADULT_VIEW.apply(adult).collect()), key=str
    )
    policy.ADULT_VIEW.view(adult, "people_view")
    assert spark.table("people_view").count() == 3


def test_variants_keep_row_count_and_columns(adult):
    variants = masking_variants(adult)
    assert tuple(variants) == VARIANTS
    for table in variants.values():
        assert table.columns == adult.columns and table.count() == 3
    partial = {r.id: r for r in variants["partial"].collect()}
    assert (partial[2].occupation, partial[2].native_country) == ("?", "?***")
    noise = {r.id: r for r in variants["noise"].collect()}
    assert noise[2].capital_gain == 0 and noise[3].capital_loss == 0
    assert 2000 <= noise[1].capital_gain <= 3000 and noise[2].hours_per_week >= 1
    assert sampled(adult, 2).count() == 2


def test_row_counts(adult):
    got = {r.table_name: r.rows for r in workloads.row_counts({"a": adult, "b": adult.limit(0)}).collect()}
    assert got == {"a": 3, "b": 0}


def test_self_join_with_a_hot_key_makes_no_pairs(spark):
    df = spark.range(100_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias(
            "occupation"
        ),
        F.concat(F.lit("e"), F.col("id") % 2).alias("education"),
        F.lit(40).alias("age"),
    )
    got = {r.education: r.match_count for r in workloads.self_join_groups(df).collect()}
    hot = 33_334
    want = {}
    for e in (0, 1):
        own_hot = sum(1 for i in range(0, 100_000, 3) if i % 2 == e)
        want[f"e{e}"] = own_hot * hot + 50_000 - own_hot
    assert {k: int(v) for k, v in got.items()} == want


def test_parameters_are_bound_not_pasted(adult):
    got = workloads.sql_with_parameters(
        adult, "SELECT count(*) AS n FROM {table} WHERE occupation = :o", o="' OR '1'='1"
    )
    assert got.first().n == 0
    assert workloads.existence_probe(adult, 2).count() == 1
    assert workloads.null_safe_match(adult, {"race": None, "age": -7}).first().id == 2


def test_published_tables(spark, tmp_path):
    from veilframe.catalog.base import adult as derived

    people = derived(spark, "/root/testdata/sf0.001")
    rows = {r.k: r for r in kanon.publish(people, str(tmp_path), ks=(2, 3)).collect()}
    for k, r in rows.items():
        stored = kanon.published(spark, str(tmp_path), k)
        assert stored.columns == ["id", *kanon.OUTPUT_COLUMNS]
        assert sorted(x.id for x in stored.select("id").collect()) == list(
            range(1, r.final_rows + 1)
        )
        smallest = kanon.check(kanon.group_sizes(stored, kanon.QUASI_IDENTIFIERS), k).first()
        assert smallest.satisfied


# --- scaling ------------------------------------------------------------------------------------


def base_table(spark):
    return spark.range(200).select(
        (F.col("id") + 1).alias("id"),
        (F.col("id") % 60 + 18).cast("int").alias("age"),
        F.when(F.col("id") % 9 != 0, (F.col("id") * 1.5)).alias("amount"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("c"), F.col("id") % 4)).alias("kind"),
        F.concat(F.lit("n"), F.col("id")).alias("name"),
    )


@pytest.mark.parametrize("array_values", [10_000, 50])
def test_perturb_stays_within_the_base(spark, array_values):
    base = base_table(spark)
    copies = synth.replicate(base, 20)
    got = synth.perturb(copies, base, array_values=array_values)
    assert got.dtypes == copies.dtypes
    row = got.select(
        F.count("*"), F.min("age"), F.max("age"), F.min("amount"), F.max("amount"),
        F.count_if(F.col("amount").isNull()), F.count_distinct("name"),
    ).first()
    assert row[0] == 4000 and row[1] >= 18 and row[2] <= 77
    assert row[3] >= 0 and row[4] <= 199 * 1.5
    assert row[5] == copies.where("amount is null").count()
    assert row[6] <= 200
    moved = got.alias("g").join(copies.alias("c"), "_row")
    for column in ("kind", "name"):
        changed = moved.where(~F.col(f"g.{column}").eqNullSafe(F.col(f"c.{column}"))).count()
        assert 0.02 < changed / 4000 < 0.07
    assert moved.where("g.id <> c.id").count() == 0


@pytest.mark.parametrize("target", [50, 200, 201, 1111])
def test_scale_rows(spark, target):
    got = synth.scale_rows(base_table(spark), target)
    assert sorted(r.id for r in got.select("id").collect()) == list(range(1, target + 1))
    assert got.columns == ["id", "age", "amount", "kind", "name"]


def test_generators(spark):
    ids = spark.range(5000)
    end = dt.date(2025, 1, 31)
    q = generators.quasi_identifiers(ids, "id", end)
    row = q.select(
        F.min("birth_year"), F.max("birth_year"), F.min("visit_date"), F.max("visit_date"),
        F.min("sensitive_value"), F.max("sensitive_value"), F.min(F.length("zip_code")),
        F.count_if(F.col("gender") == "O"), F.min("diagnosis_code"), F.max("diagnosis_code"),
    ).first()
    assert (row[0], row[1]) == (1940, 2004)
    assert row[2] >= dt.date(2023, 2, 1) and row[3] == end
    assert 100 <= row[4] and row[5] < 10_000 and row[6] == 5
    assert 50 < row[7] < 160 and row[8] >= "D100" and row[9] <= "D998"
    h = generators.high_cardinality(ids, "id", dt.datetime(2025, 1, 31))
    assert h.select("uuid").distinct().count() == 5000
    assert h.where(~F.col("uuid").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}$")).count() == 0
    assert h.where(~F.col("email").rlike("^[a-z]+\\.[a-z]+[0-9]+@example\\.(com|net|org)$")).count() == 0


# --- reports -----------------------------------------------------------------------------------------


def test_summary_labels_and_overhead(spark):
    rows = [
        (f"{system}_{name}", system, 0, run, base * factor + run, 10 + run)
        for system, factor in (("raw", 1), ("view", 2))
        for name, base in (("range", 100.0), ("topk", 40.0), ("odd", 1.0))
        for run in range(3)
    ]
    rows.append(("raw_point_lookup", "raw", 0, 5, 8.0, 1))
    runs = spark.createDataFrame(
        rows, "experiment string, system string, query_idx int, run int, "
        "wall_clock_ms double, row_count int"
    )
    summary = report.measurement_summary(runs)
    got = {r.experiment: r for r in summary.collect()}
    assert got["raw_range"].wall_clock_median_ms == 101.0 and got["raw_range"].row_count == 10
    assert got["raw_range"].wall_clock_std_ms == 1.0
    assert got["raw_point_lookup"].wall_clock_std_ms == 0.0
    overhead = {r.workload: r for r in report.overhead_pivot(summary).collect()}
    assert set(overhead) == {"range", "topk", "point_lookup"}
    assert overhead["range"].view == 99.0 and overhead["range"].dynamic is None


def test_plan_metrics(spark):
    documents = [
        json.dumps({"Plan": {"Plan Rows": 50, "Actual Rows": 100, "Actual Total Time": 2.5},
                    "Shared Hit Blocks": 3, "Shared Read Blocks": 4}),
        json.dumps({"Plan": {"Plan Rows": 5, "Actual Rows": 0}, "Execution Time": 9.0}),
        None,
    ]
    df = spark.createDataFrame(
        [("e", "raw", i, d) for i, d in enumerate(documents)],
        "experiment string, system string, query_idx int, explain_plan string",
    )
    got = {r.query_idx: r for r in report.plan_metrics(df).collect()}
    assert (got[0].row_estimate_error, got[0].actual_time_ms, got[0].buffer_blocks) == (0.5, 2.5, 7)
    assert (got[1].row_estimate_error, got[1].actual_time_ms) == (0.0, 9.0)
    assert set(got) == {0, 1}
    assert report.plan_summary(report.plan_metrics(df)).first().row_estimate_error == 0.25


# --- files -------------------------------------------------------------------------------------------


def test_csv_by_position_and_replaced_table(spark, adult, tmp_path):
    source = tmp_path / "a.csv"
    source.write_text("x,y\n1,a\n2,\n")
    two = schemas.T.StructType(schemas.SURROGATE_MAPPING.fields[:2])
    got = files.read_csv(spark, str(source), two).collect()
    assert [tuple(r) for r in got] == [("1", "a"), ("2", None)]
    target = str(tmp_path / "t")
    files.load_csv(spark, str(source), target, two)
    assert files.load_csv(spark, str(source), target, two).count() == 2


def test_headerless_lines_get_ids_in_file_order(spark, tmp_path):
    source = tmp_path / "adult.data"
    row = "39, State-gov, 77516, Bachelors, 13, Never-married, Adm-clerical, Not-in-family, " \
          "White, Male, 2174, 0, 40, United-States, <=50K\n"
    source.write_text("".join(row.replace("39", str(20 + i)) for i in range(50)))
    raw = files.read_csv(
        spark, str(source), schemas.ADULT_WITHOUT_ID, header=False, trim_leading=True
    )
    got = files.number_lines(raw).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 51))
    assert [r.age for r in got] == list(range(20, 70)) and got[0].workclass == "State-gov"


def test_number_lines_over_several_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 1000, 1, 6).write.csv(path)
    got = files.number_lines(spark.read.schema("v bigint").csv(path)).collect()
    assert sorted(r.id for r in got) == list(range(1, 1001))
    # The files' names rise with the part, and so do the ids.
    assert {r.v: r.id for r in got} == {v: v + 1 for v in range(1000)}


def test_number_lines_over_split_files(spark, tmp_path):
    """A large file read in many splits, between two small ones."""
    for name, first, count in (("b.csv", 10, 20_000), ("a.csv", 0, 10), ("c.csv", 20_010, 7)):
        (tmp_path / name).write_text("".join(f"{v}\n" for v in range(first, first + count)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        raw = spark.read.schema("v bigint").csv(str(tmp_path))
        assert raw.select("_metadata.file_block_start").distinct().count() > 5
        got = files.number_lines(raw, "n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.v: r.n for r in got} == {v: v + 1 for v in range(20_017)}


def test_latest_metrics_and_documents(spark, tmp_path):
    for name, n in (("summary_1.json", 1), ("summary_2.json", 2)):
        (tmp_path / name).write_text(json.dumps([{"n": n}, {"n": n + 10}], indent=2))
    got = files.read_latest_metrics(spark, f"{tmp_path}/summary_*.json", one_document=True)
    assert sorted(r.n for r in got.collect()) == [2, 12]
    with pytest.raises(FileNotFoundError):
        files.latest_path(spark, f"{tmp_path}/nothing_*.json")
    with pytest.raises(ValueError):
        files.write_metrics(got, str(tmp_path / "x"), "xml")


def test_save_table_replaces(spark):
    name = f"veil_saved_{uuid.uuid4().hex}"
    files.save_table(spark.range(3), name)
    assert files.save_table(spark.range(5), name).count() == 5
    spark.sql(f"DROP TABLE {name}")


def a_session(spark, master, **conf):
    """What the folder functions see of a session with another master and settings."""
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)),
        sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
        _jvm=spark._jvm,
        _jsc=spark._jsc,
    )


def test_shared_dir_comes_from_the_session(spark):
    assert fresh_path(spark, "x").startswith(shared_dir(spark))
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
    far = a_session(spark, "spark://h:7077", **{"spark.checkpoint.dir": "hdfs://a/b/"})
    assert fresh_path(far, "x").startswith("hdfs://a/b/veilframe/app-1/x-")


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_a_local_session_without_the_setting_uses_its_warehouse(spark, master, tmp_path):
    near = a_session(spark, master, **{"spark.sql.warehouse.dir": str(tmp_path)})
    assert shared_dir(near) == f"{tmp_path}/_intermediates"


@pytest.mark.parametrize("master", ["spark://h:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_the_setting(spark, master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(a_session(spark, master, **{"spark.sql.warehouse.dir": "/w"}))


def test_intermediates_of_this_application_are_removed(spark, tmp_path):
    own = a_session(spark, "local", **{"spark.checkpoint.dir": str(tmp_path)})
    path = fresh_path(own, "x")
    spark.range(3).write.parquet(path)
    other = tmp_path / "veilframe" / "app-2"
    other.mkdir()
    assert remove_intermediates(own)
    assert not Path(path).exists() and other.exists()
    assert not remove_intermediates(own)


def test_policies_run_on_a_stream(spark, adult, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    adult.write.parquet(source)
    stream = policy.ADULT_VIEW.apply(spark.readStream.schema(schemas.ADULT).parquet(source))
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", state)
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination(120)
    assert spark.read.parquet(out).count() == 3


# --- checked loads -------------------------------------------------------------------------------------

_THREE = schemas.T.StructType(
    [
        schemas.T.StructField("id", schemas.T.IntegerType()),
        schemas.T.StructField("name", schemas.T.StringType()),
        schemas.T.StructField("amount", schemas.T.DecimalType(5, 2)),
    ]
)
_LINES = {
    "1,a,1.50": None,
    '2,"b, c",2.00': None,
    "3,,": None,
    ",,": None,
    "x,a,1.50": "value",
    "4,a,123456.00": "value",
    "5,a": "short",
    "6": "short",
    "7,a,1.50,": "surplus",
    '8,"a,b",1.50,"c,d"': "surplus",
    '9,"a, b"': "short",
}


def _broken(tmp_path):
    source = tmp_path / "broken"
    source.mkdir()
    (source / "one.csv").write_text("id,name,amount\n" + "\n".join(_LINES) + "\n\n")
    (source / "two.csv").write_text("id,name,amount\n10,z,1.00\n")
    return str(source)


def test_every_line_is_a_row_or_quarantined(spark, tmp_path):
    rows, bad = files.read_csv_checked(spark, _broken(tmp_path), _THREE)
    got = {(r.id, r.name, r.amount) for r in rows.collect()}
    assert got == {
        (1, "a", Decimal("1.50")), (2, "b, c", Decimal("2.00")), (3, None, None),
        (None, None, None), (10, "z", Decimal("1.00")),
    }
    assert {r.line: r.reason for r in bad.collect()} == {k: v for k, v in _LINES.items() if v}
    assert all(r.file.endswith("one.csv") for r in bad.collect())
    # Whatever is asked for, the same lines are bad.
    assert rows.select("name").count() == rows.count() == 5 and bad.count() == 7
    assert rows.select("name").where("name = 'a'").count() == 1


def test_loads_with_malformed_lines(spark, tmp_path):
    source, target = _broken(tmp_path), str(tmp_path / "t")
    files.write_parquet(spark.createDataFrame([(0, "old", None)], _THREE), target)
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        files.load_csv(spark, source, target, _THREE)
    assert [r.name for r in spark.read.parquet(target).collect()] == ["old"]
    aside = str(tmp_path / "aside")
    loaded = files.load_csv(spark, source, target, _THREE, malformed="quarantine", quarantine_path=aside)
    assert loaded.count() == 5
    counts = {r.reason: r.lines for r in files.quarantined(spark, aside).collect()}
    assert counts == {"value": 2, "short": 3, "surplus": 2}
    assert files.load_csv(spark, source, target, _THREE, malformed="null").count() == 12
    with pytest.raises(ValueError):
        files.load_csv(spark, source, target, _THREE, malformed="quarantine")
    with pytest.raises(ValueError):
        files.load_csv(spark, source, target, _THREE, malformed="skip")


def test_nothing_malformed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,amount\n1,a,1.00\n")
    (tmp_path / "empty.csv").write_text("")
    aside = str(tmp_path / "aside")
    for path, n in (("a.csv", 1), ("empty.csv", 0)):
        loaded = files.load_csv(
            spark, str(tmp_path / path), str(tmp_path / "t"), _THREE, "quarantine", aside
        )
        assert loaded.count() == n and files.quarantined(spark, aside).count() == 0


# --- replaced tables ---------------------------------------------------------------------------------------


def _failing(spark):
    return spark.range(100).select(
        F.when(F.col("id") == 99, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id")
    )


def test_a_failed_replacement_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_parquet(spark.range(3), path)
    with pytest.raises(Exception, match="lost"):
        files.write_parquet(_failing(spark), path)
    assert spark.read.parquet(path).count() == 3
    files.write_parquet(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    swap.recover(spark, path)
    assert [p.name for p in tmp_path.iterdir()] == ["t"]

    name = f"veil_kept_{uuid.uuid4().hex}"
    files.save_table(spark.range(3), name)
    with pytest.raises(Exception, match="lost"):
        files.save_table(_failing(spark), name)
    assert spark.table(name).count() == 3
    assert files.save_table(spark.table(name).where("id = 1"), name).count() == 1
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith(name)] == [name]
    spark.sql(f"DROP TABLE {name}")


def test_a_crash_between_the_renames_is_recovered(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    files.write_parquet(spark.range(3), path)
    real, calls = swap._rename, []

    def stop(spark, source, target):
        calls.append(target)
        if len(calls) == 2:
            raise KeyboardInterrupt
        real(spark, source, target)

    monkeypatch.setattr(swap, "_rename", stop)
    with pytest.raises(KeyboardInterrupt):
        files.write_parquet(spark.range(9), path)
    monkeypatch.setattr(swap, "_rename", real)
    assert not (tmp_path / "t").exists()
    assert swap.read_replaced(spark, path).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    # Writing again restores the name as well.
    calls.clear()
    monkeypatch.setattr(swap, "_rename", stop)
    with pytest.raises(KeyboardInterrupt):
        files.write_parquet(spark.range(9), path)
    monkeypatch.setattr(swap, "_rename", real)
    assert files.write_parquet(spark.range(5), path).count() == 5


def test_a_first_write_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(Exception, match="lost"):
        files.write_parquet(_failing(spark), path)
    assert not (tmp_path / "t").exists() and not swap.recover(spark, path)
    assert not [p for p in tmp_path.iterdir() if not p.name.endswith(".crc")]


# --- filters through masks --------------------------------------------------------------------------------


def test_filters_on_a_view_keep_the_masked_rows(spark):
    values = [-260, -250, -249, -150, -51, -50, -7, -5, -1, 0, 1, 4, 5, 49, 50, 51, 99, 100, 149, 150, 250]
    texts = ["Sales", "Sa", "S", "", "?", "Sal***", None, "Craft"]
    levels = ["HS-grad", "Masters", "7th-8th", "Other", " HS-grad ", None, "unknown"]
    rows = [
        (i, v, Decimal(v) + Decimal("0.50"), float(v) + 0.25, texts[i % 8], levels[i % 7])
        for i, v in enumerate([*values, *values, None])
        for v in [v if v is not None else 0]
    ] + [(1000, None, None, None, None, None)]
    df = spark.createDataFrame(
        rows, "id bigint, whole int, amount decimal(10,2), real double, job string, level string"
    )
    masked = policy.MaskingPolicy(
        key="k",
        rules={
            "whole": policy.bucketed(5),
            "amount": policy.rounded(100),
            "real": policy.bucketed(50),
            "job": policy.partial(2, keep=("?",)),
            "level": policy.generalized(policy.taxonomy.VIEW_EDUCATION),
        },
    )
    seen = masked.apply(df)
    conditions = [policy.Between("whole", a, b) for a in (-8, -5, 0, 3, 50) for b in (-5, 0, 4, 50, 100)]
    conditions += [policy.Between("amount", a, b) for a in (-300, -100, 0, 50) for b in (-100, 0, 100, 149, 300)]
    conditions += [policy.Between("real", a, b) for a in (-260, -50, 0) for b in (-50, 0, 60)]
    conditions += [policy.Equals("whole", v) for v in (-5, 0, 5, 7)]
    conditions += [policy.Equals("job", v) for v in ("Sa***", "S***", "***", "?", "?***", "Sales", "Sal***")]
    conditions += [policy.Equals("level", v) for v in ("HS-Some-College", "Some-School", "Masters", "unknown", "x")]
    conditions += [policy.Equals("id", 3), policy.Between("id", 2, 9)]
    for condition in conditions:
        expected = sorted(r.id for r in seen.where(condition.on(F.col(condition.column))).collect())
        found = masked.where(df, condition)
        assert found.columns == seen.columns
        assert sorted(r.id for r in found.collect()) == expected, condition
    both = masked.where(df, policy.Between("whole", 0, 50), policy.Equals("job", "Sa***"), role="masked_user")
    assert both.count() == seen.where("whole between 0 and 50 and job = 'Sa***'").count() > 0
    open_role = masked.where(df, policy.Equals("job", "Sales"), role="owner")
    assert open_role.count() == df.where("job = 'Sales'").count() and "whole" in open_role.columns


# --- published tables and sketches -------------------------------------------------------------------------


def test_publishing_without_rows_and_by_join(spark, tmp_path, monkeypatch):
    from veilframe.catalog.base import adult as derived

    people = derived(spark, "/root/testdata/sf0.001")
    expected = {}
    for k in (2, 4):
        rows = kanon.anonymous_table(people, k).collect()
        expected[k] = sorted(tuple(map(str, r)) for r in rows)
    for name, keys in (("broadcast", 100_000), ("join", 5)):
        monkeypatch.setattr(kanon, "HOT_KEYS", keys)
        kanon.publish(people, str(tmp_path / name), ks=(4, 2))
        for k in (2, 4):
            got = kanon.published(spark, str(tmp_path / name), k).collect()
            assert sorted(tuple(map(str, r)) for r in got) == expected[k]
    with pytest.raises(ValueError):
        kanon.published(spark, str(tmp_path / "join"), 3)
    none = kanon.publish(people, str(tmp_path / "none"), ks=(1_000_000,)).first()
    assert none.final_rows == 0
    assert kanon.published(spark, str(tmp_path / "none"), 1_000_000).count() == 0
    assert kanon.publish(people.limit(0), str(tmp_path / "empty"), ks=(2,)).first().final_rows == 0
    assert kanon.published(spark, str(tmp_path / "empty"), 2).columns == ["id", *kanon.OUTPUT_COLUMNS]


def test_sketches_of_parts_count_like_one(spark, tmp_path):
    df = spark.range(60_000).select(
        (F.col("id") % 3).alias("g"), (F.col("id") % 20_000).alias("v"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("n"), F.col("id") % 7)).alias("w"), "id",
    )
    path = str(tmp_path / "s")
    for part in range(4):
        sketches.store_part(df.where(F.col("id") % 4 == part), path, f"p{part}", ["g"], ["v", "w"])
    sketches.store_part(df.where(F.col("id") % 4 == 2), path, "p2", ["g"], ["v", "w"])  # once more
    again = sketches.stored(spark, path)
    whole = sketches.sketch_by(df, ["g"], ["v", "w"])
    bound = sketches.relative_error()
    for parts in (again, whole):
        for r in sketches.estimates(parts, ["g"], ["v", "w"]).collect():
            exact = df.where(F.col("g") == r.g).agg(F.countDistinct("v"), F.countDistinct("w")).first()
            assert r.rows == 20_000 and r.w == exact[1]
            assert abs(r.v - exact[0]) <= bound * exact[0]
    # Rolled up to the whole table.
    total = sketches.estimates(again, [], ["v", "w"]).first()
    assert total.rows == 60_000 and abs(total.v - 20_000) <= bound * 20_000 and total.w == 7
    masked = sketches.sketch_by(df.withColumn("v", F.floor(F.col("v") / 10)), [], ["v", "w"])
    ratios = {r.column: r.cardinality_ratio for r in sketches.distinct_ratios(again, masked, ["v", "w"]).collect()}
    assert abs(ratios["v"] - 0.1) <= 0.1 * 2 * bound and ratios["w"] == 1.0
    nothing = sketches.estimates(sketches.sketch_by(df.limit(0), ["g"], ["v"]), ["g"], ["v"])
    assert nothing.count() == 0
    nulls = df.withColumn("v", F.lit(None).cast("string"))
    assert {r.v for r in sketches.estimates(sketches.sketch_by(nulls, ["g"], ["v"]), ["g"], ["v"]).collect()} == {0}
    with pytest.raises(ValueError):
        sketches.store_part(df, path, "a/b", ["g"], ["v"])
