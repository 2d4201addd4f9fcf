"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from veilframe.catalog import REGISTRY
from veilframe.catalog.base import adult
from veilframe.functions.masks import bucket_between
from veilframe.operators import kanon, synth
from veilframe.operators.rank import dense_ids, exact_sample, keyed_rank
from veilframe.operators.shuffle import shuffle_columns
from veilframe.operators.surrogate import apply_mapping, extend_mapping
from veilframe.operators.surrogate_store import open_store
from veilframe.plans import policy, workloads
from veilframe.session import fresh_path, stored_once
from veilframe.sources.files import number_lines
from veilframe.sources.layout import write_clustered

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def people(spark):
    path = fresh_path(spark, "plan-adult")
    adult(spark, SF_DIR).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(REGISTRY[name].run(spark, SF_DIR))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text, node


def test_point_lookup_reaches_the_scan_through_a_mask(people):
    text = plan(workloads.point_lookup(policy.ADULT_VIEW.apply(people), 7))
    assert "EqualTo(id,7)" in text


def test_count_over_a_masked_table_reads_one_column(people):
    masked = policy.ADULT_RULES.apply(people)
    text = plan(workloads.count_by(masked, "education"))
    assert re.search(r"ReadSchema: struct<id:bigint>", text)


def test_masked_range_as_a_raw_range_is_pushed_down(people):
    on_mask = plan(workloads.range_count(policy.ADULT_VIEW.apply(people)))
    on_raw = plan(people.where(bucket_between(F.col("age"), 5, 25, 45)))
    assert "GreaterThanOrEqual(age,25)" not in on_mask
    assert "GreaterThanOrEqual(age,25)" in on_raw and "LessThanOrEqual(age,49)" in on_raw


def test_top_k_sorts_no_whole_table(people):
    assert "TakeOrderedAndProject" in plan(workloads.top_groups(people))


def test_exact_sample_filters_in_place(people):
    text = plan(exact_sample(people, "id", 10, "k"))
    outer = text.split("Subquery")[0]
    assert "Exchange" not in outer and "Sort" not in outer


def test_rank_windows_are_partitioned(people):
    text = plan(keyed_rank(people.select("id"), "id", "k", "l"))
    for window in re.findall(r"Window \[.*", text):
        if "row_number" in window:
            assert "_bucket" in window.split("windowspecdefinition(")[1].split(",")[0]


def test_ranked_rows_are_not_broadcast(spark):
    path = fresh_path(spark, "few")
    spark.range(100).write.parquet(path)
    # The files look small; an explode makes many rows of them.
    many = spark.read.parquet(path).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(200))))
    many = many.select((F.col("id") * 200 + F.col("n")).alias("id"))
    for ranked in (keyed_rank(many, "id", "k", "l"), dense_ids(many, "id", "rank", 1_000)):
        text = plan(ranked)
        assert "BuildLeft" not in text
        assert text.index("Join") < text.index("row_number"), "numbered before the join"
        assert sorted(r["rank"] for r in ranked.select("rank").collect()) == list(range(1, 20_001))


def test_numbering_lines_moves_no_line(spark, people):
    path = fresh_path(spark, "lines")
    people.select("age", "income").write.csv(path)
    numbered = number_lines(spark.read.schema("age int, income string").csv(path))
    text = plan(numbered)
    assert "SortMergeJoin" not in text
    assert "income" not in "".join(line for line in text.splitlines() if "Exchange" in line)


def test_sweep_shuffles_rows_once(people):
    text = plan(kanon.sweep(kanon.generalize(people), kanon.QUASI_IDENTIFIERS))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert len(re.findall(r"FileScan", text)) == 1


def test_suppression_counts_groups_once(people):
    rows = kanon.generalize(people)
    kept = kanon.suppress(rows, kanon.QUASI_IDENTIFIERS, 2)
    kept.collect()
    final = plan(kept).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan(kept) and "SortMergeJoin" not in final


def test_self_join_meets_after_aggregation(people):
    text = plan(workloads.self_join_groups(people))
    join = min(text.index(n) for n in ("SortMergeJoin", "BroadcastHashJoin") if n in text)
    assert "HashAggregate" in text[join:]


def test_distinct_count_is_two_phase(people):
    text = plan(workloads.distinct_by(people, "education", "occupation", "n"))
    assert "partial_count(distinct" in text


def test_shuffle_buckets_follow_the_row_count(people):
    text = plan(shuffle_columns(people, ["occupation"], rows_per_bucket=300))
    buckets = re.findall(r"FLOOR\(\(_draw#\d+ \* [^\n]*", text)
    assert buckets and all("scalar-subquery" in b or "Subquery" in b for b in buckets)
    few = plan(shuffle_columns(people, ["occupation", "native_country"], wanted=["id", "age"]))
    assert "Exchange" not in few and "Join" not in few


def test_scaled_rows_are_made_by_several_tasks(spark):
    base = spark.range(50).coalesce(1).select("id", F.lit("x").alias("t"))
    assert base.rdd.getNumPartitions() == 1
    assert synth.replicate(base, 700).rdd.getNumPartitions() > 1
    assert synth.replicate(base, 700).selectExpr("count(distinct _row)").first()[0] == 35_000


def scanned_rows(df) -> int:
    """Rows the one scan of an executed plan without a shuffle has let through."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.size() == 1
    return leaves.head().metrics().apply("numOutputRows").value()


def test_key_reads_of_a_clustered_table_skip_row_groups(spark):
    people = adult(spark, SF_DIR)
    total = people.count()
    by_age = write_clustered(
        people, fresh_path(spark, "by-age"), ["age"], ["id"], rows_per_file=400, rows_per_group=100
    )
    assert by_age.count() == total and by_age.columns == people.columns
    assert len(by_age.inputFiles()) == -(-total // 400)
    as_it_came = fresh_path(spark, "unclustered")
    people.repartition(4).write.option("parquet.block.row.count.limit", 100).parquet(as_it_came)
    plain = spark.read.parquet(as_it_came)
    wanted = people.agg(F.max("id")).first()[0]
    range_of_ages, point = "age between 25 and 30", f"id = {wanted}"
    assert scanned_rows(plain.where(range_of_ages)) == total
    assert scanned_rows(by_age.where(range_of_ages)) <= total / 4
    # The Bloom filter: ids are spread over all row groups, yet few are read.
    assert scanned_rows(by_age.where(point)) <= 300 < total
    assert by_age.where(point).count() == 1 and by_age.where("id = -1").count() == 0
    both = write_clustered(
        people, fresh_path(spark, "by-both"), ["age", "fnlwgt"], interleave=True,
        rows_per_file=800, rows_per_group=50,
    )
    for condition in (range_of_ages, "fnlwgt < 30000"):
        assert scanned_rows(both.where(condition)) <= total / 2
        assert both.where(condition).count() == people.where(condition).count()


def test_a_hot_key_is_spread_over_files(spark):
    rows = spark.range(6000).select(F.lit(7).alias("k"), "id").union(spark.range(500).select(F.col("id") % 50, "id"))
    path = fresh_path(spark, "hot")
    write_clustered(rows, path, ["k"], rows_per_file=500)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 6500 and max(sizes) < 1500
    empty = write_clustered(rows.limit(0), fresh_path(spark, "none"), ["k", "id"], interleave=True)
    assert empty.count() == 0 and empty.columns == ["k", "id"]
    nulls = spark.createDataFrame([(None, 1), (2, None), (1, 5)], "k int, id int")
    kept = write_clustered(nulls, fresh_path(spark, "nulls"), ["k", "id"], ["k"], interleave=True)
    assert {tuple(r) for r in kept.collect()} == {(None, 1), (2, None), (1, 5)}


def test_a_clustered_file_has_a_bounded_number_of_row_groups(spark):
    rows = spark.range(0, 6000, 1, 2).withColumn("k", F.col("id") % 7)
    path = fresh_path(spark, "small-groups")
    laid = write_clustered(rows, path, ["k"], rows_per_group=2)
    sizes = [r["count"] for r in laid.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 3 and max(sizes) <= 2 * 1_300
    assert laid.exceptAll(rows.select(*laid.columns)).count() == 0 and laid.count() == 6000


def test_filters_on_a_view_reach_the_scan(spark, people):
    seen = policy.ADULT_VIEW.where(
        people, policy.Between("age", 25, 45), policy.Equals("education", "Some-School"),
        policy.Equals("occupation", "Exe***"), policy.Equals("income", ">50K"),
    )
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        text = plan(seen)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    for pushed in (
        "GreaterThanOrEqual(age,25)", "LessThanOrEqual(age,49)", "In(education, ",
        "StringStartsWith(occupation,Exe)", "EqualTo(income,>50K)",
    ):
        assert pushed in text
    on_mask = policy.ADULT_VIEW.apply(people).where("age between 25 and 45")
    assert scanned_rows(seen.select("id")) <= people.count()
    assert "GreaterThanOrEqual(age,25)" not in plan(on_mask)


def test_surrogate_rows_move_once_for_any_number_of_columns(spark, people):
    columns = ["workclass", "education", "occupation", "native_country"]
    mapping = extend_mapping(people, columns, key="k")
    for n in (1, 4):
        # No broadcast stands in for the shuffled joins, and no value is hot.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            text = plan(apply_mapping(people, columns[:n], mapping, hot_keys=1))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        wide = [line for line in text.split("== Initial Plan ==")[-1].splitlines() if "Exchange hashpartitioning(_srow#" in line]
        moved = [line for line in wide if "ENSURE_REQUIREMENTS" in line]
        assert len(moved) == 2  # the rows, and the row numbers with their surrogates


def test_a_two_valued_column_stays_in_place(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("v"))
    got = apply_mapping(rows, ["v"], extend_mapping(rows, ["v"], key="k"))
    assert got.where("v like 'SRG-%'").count() == 2000
    # As many tasks as the source has hold equally many of the answers.
    per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) >= rows.rdd.getNumPartitions() > 1 and max(per_task) <= 2000 / 2


def test_the_stored_mapping_is_not_shuffled(spark, people, tmp_path):
    store = open_store(spark, str(tmp_path / "store"), buckets=8)
    store.add(people.limit(200), ["fnlwgt"], key="one")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(store.unseen(people, ["fnlwgt"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stored = text[text.rindex("Sort ["):]  # the join's right side, the last branch of the plan
    assert "Bucketed: true" in stored and "Exchange" not in stored


def test_publishing_scans_the_source_twice(spark, people, tmp_path, monkeypatch):
    """Once summed up, once row by row, for any number of k."""
    for ks in ((2,), (2, 3, 5)):
        read = []
        monkeypatch.setattr(
            kanon, "stored_once",
            lambda df, label: (read.append(plan(df).split("== Initial Plan ==")[-1].count("plan-adult")), stored_once(df, label))[1],
        )
        report = kanon.publish(people, str(tmp_path / str(len(ks))), ks=ks)
        assert sum(read) == 2 and "plan-adult" not in plan(report)
    assert "band" in plan(kanon.published(spark, str(tmp_path / "3"), 3)).split("PartitionFilters")[1]
