"""Workload queries over the raw person tables and the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.catalog.base import (
    HEALTHCARE_COLUMNS,
    HEALTHCARE_OUT,
    adult,
    healthcare,
    plain,
    projection,
    register,
    table,
    with_adult,
    with_healthcare,
)
from veilframe.operators import sketches
from veilframe.plans import policy, report, workloads
from veilframe.session import fresh_path
from veilframe.sources import layout

DIGITS = 6


# --- lookups, ranges, predicates ------------------------------------------------------------


@register("point_lookup", with_adult("SELECT * FROM adult WHERE id = 5000"))
def point_lookup(spark, sf_dir):
    return workloads.point_lookup(adult(spark, sf_dir), 5000)


@register(
    "point_lookup_health",
    with_healthcare(
        f"SELECT {projection(HEALTHCARE_COLUMNS, HEALTHCARE_OUT)} FROM healthcare WHERE id = 5000"
    ),
)
def point_lookup_health(spark, sf_dir):
    return plain(workloads.point_lookup(healthcare(spark, sf_dir), 5000))


@register("range_count", with_adult("SELECT COUNT(*) AS cnt FROM adult WHERE age BETWEEN 25 AND 45"))
def range_count(spark, sf_dir):
    return workloads.range_count(adult(spark, sf_dir))


# --- the same over a table laid out for key reads -----------------------------------------------


def _clustered(spark, sf_dir, keys, lookups=(), interleave=False):
    return layout.write_clustered(
        adult(spark, sf_dir), fresh_path(spark, "adult-clustered"), keys, lookups, interleave,
        rows_per_file=4_000, rows_per_group=500,
    )


@register("clustered_point", with_adult("SELECT * FROM adult WHERE id = 5000"))
def clustered_point(spark, sf_dir):
    """A lookup by a column the table is not clustered by: Bloom filters skip row groups."""
    return workloads.point_lookup(_clustered(spark, sf_dir, ["age"], ["id"]), 5000)


@register("clustered_range", with_adult("SELECT COUNT(*) AS cnt FROM adult WHERE age BETWEEN 25 AND 45"))
def clustered_range(spark, sf_dir):
    return workloads.range_count(_clustered(spark, sf_dir, ["age"]))


@register("clustered_probe", with_adult("SELECT 1 AS found FROM adult WHERE id = 4999"))
def clustered_probe(spark, sf_dir):
    return workloads.existence_probe(_clustered(spark, sf_dir, ["id"]), 4999)


@register(
    "clustered_box",
    with_adult(
        "SELECT COUNT(*) AS cnt, CAST(SUM(fnlwgt) AS BIGINT) AS total FROM adult "
        "WHERE age BETWEEN 30 AND 35 AND capital_gain BETWEEN 20000 AND 40000"
    ),
)
def clustered_box(spark, sf_dir):
    """A range on each of two keys, over rows clustered by both alike."""
    people = _clustered(spark, sf_dir, ["age", "capital_gain"], interleave=True)
    return people.where("age between 30 and 35 and capital_gain between 20000 and 40000").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("fnlwgt").alias("total")
    )


@register(
    "range_avg",
    with_healthcare(
        "SELECT round(CAST(SUM(billing_amount) AS DOUBLE) / COUNT(billing_amount), 6) AS avg_value "
        "FROM healthcare WHERE age BETWEEN 30 AND 50"
    ),
)
def range_avg(spark, sf_dir):
    return plain(workloads.range_avg(healthcare(spark, sf_dir)), DIGITS)


@register("equality_filter", with_adult("SELECT COUNT(*) AS cnt FROM adult WHERE age = 35"))
def equality_filter(spark, sf_dir):
    return workloads.equality_count(adult(spark, sf_dir), 35)


@register("existence_probe", "SELECT 1 AS found FROM customer WHERE c_custkey = 77")
def existence_probe(spark, sf_dir):
    return workloads.existence_probe(table(spark, sf_dir, "customer"), 77, "c_custkey")


@register(
    "above_avg",
    with_adult(
        "SELECT round(CAST(SUM(hours_per_week) AS DOUBLE) / COUNT(hours_per_week), 6) AS avg_value "
        "FROM adult WHERE age > 33"
    ),
)
def above_avg(spark, sf_dir):
    return plain(workloads.above_avg(adult(spark, sf_dir), 33), DIGITS)


@register(
    "null_sentinel_filter",
    with_adult(
        "SELECT id, occupation FROM adult WHERE occupation IS NOT NULL AND occupation <> '?'"
    ),
)
def null_sentinel_filter(spark, sf_dir):
    return workloads.not_unknown(adult(spark, sf_dir), "occupation").select("id", "occupation")


@register(
    "null_safe_match",
    with_adult(
        "SELECT id, age, education, race FROM adult "
        "WHERE education = 'Masters' AND race IS NULL"
    ),
)
def null_safe_match(spark, sf_dir):
    matched = workloads.null_safe_match(
        adult(spark, sf_dir), {"education": "Masters", "race": None}
    )
    return matched.select("id", "age", "education", "race")


@register(
    "conjunction_filter",
    "SELECT p_partkey, p_size, p_type FROM part "
    "WHERE p_size > 30 AND p_type IN ('ECONOMY', 'PROMO') AND p_retailprice < 950",
)
def conjunction_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where(
        (F.col("p_size") > 30)
        & F.col("p_type").isin("ECONOMY", "PROMO")
        & (F.col("p_retailprice") < 950)
    ).select("p_partkey", "p_size", "p_type")


# --- parameterised statements ------------------------------------------------------------------


@register(
    "param_range_group",
    with_adult(
        "SELECT education, COUNT(*) AS cnt FROM adult WHERE age BETWEEN 25 AND 47 "
        "GROUP BY education ORDER BY education NULLS LAST LIMIT 5"
    ),
)
def param_range_group(spark, sf_dir):
    return workloads.bound_range_groups(adult(spark, sf_dir), 25, 47)


@register(
    "param_sql",
    with_adult(
        "SELECT occupation, COUNT(*) AS cnt FROM adult "
        "WHERE age BETWEEN 77 % 60 + 18 AND 77 % 60 + 40 GROUP BY occupation"
    ),
)
def param_sql(spark, sf_dir):
    return workloads.sql_with_parameters(
        adult(spark, sf_dir),
        "SELECT occupation, COUNT(*) AS cnt FROM {table} "
        "WHERE age BETWEEN :id % 60 + 18 AND :id % 60 + 40 GROUP BY occupation",
        id=77,
    )


@register(
    "param_sweep",
    with_adult(
        "SELECT low, high, education, COUNT(*) AS cnt FROM adult "
        "JOIN ranges ON age BETWEEN low AND high GROUP BY low, high, education",
        "ranges AS (SELECT DISTINCT CAST(c_custkey % 60 + 18 AS INTEGER) AS low, "
        "CAST(c_custkey % 60 + 40 AS INTEGER) AS high FROM customer)",
    ),
)
def param_sweep(spark, sf_dir):
    return workloads.range_groups_for_all(
        adult(spark, sf_dir), table(spark, sf_dir, "customer"), "c_custkey", "education"
    )


# --- grouping --------------------------------------------------------------------------------------


@register(
    "group_two_keys_topk",
    with_adult(
        "SELECT education, income, COUNT(*) AS cnt, "
        "round(CAST(SUM(age) AS DOUBLE) / COUNT(age), 6) AS avg_age FROM adult "
        "GROUP BY education, income ORDER BY cnt DESC, education, income LIMIT 20"
    ),
)
def group_two_keys_topk(spark, sf_dir):
    return plain(workloads.top_pairs(adult(spark, sf_dir)), DIGITS)


@register(
    "group_two_keys_health",
    with_healthcare(
        "SELECT medical_condition, gender, COUNT(*) AS patient_count, "
        "round(CAST(SUM(billing_amount) AS DOUBLE) / COUNT(billing_amount), 6) AS avg_billing "
        "FROM healthcare GROUP BY medical_condition, gender "
        "ORDER BY patient_count DESC, medical_condition, gender LIMIT 20"
    ),
)
def group_two_keys_health(spark, sf_dir):
    return plain(
        workloads.top_pairs(
            healthcare(spark, sf_dir),
            ("medical_condition", "gender"),
            "billing_amount",
            "patient_count",
            "avg_billing",
        ),
        DIGITS,
    )


@register(
    "topk_groups",
    with_adult(
        "SELECT occupation, COUNT(*) AS frequency, "
        "round(CAST(SUM(age) AS DOUBLE) / COUNT(age), 6) AS avg_age, "
        "round(CAST(SUM(hours_per_week) AS DOUBLE) / COUNT(hours_per_week), 6) AS avg_hours "
        "FROM adult WHERE occupation IS NOT NULL AND occupation <> '?' "
        "GROUP BY occupation ORDER BY frequency DESC, occupation LIMIT 10"
    ),
)
def topk_groups(spark, sf_dir):
    return plain(workloads.top_groups(adult(spark, sf_dir)), DIGITS)


@register(
    "topk_min_max",
    with_healthcare(
        "SELECT medication, COUNT(*) AS prescription_count, "
        "round(CAST(SUM(billing_amount) AS DOUBLE) / COUNT(billing_amount), 6) AS avg_cost, "
        "CAST(MIN(billing_amount) AS DOUBLE) AS min_cost, "
        "CAST(MAX(billing_amount) AS DOUBLE) AS max_cost "
        "FROM healthcare WHERE medication IS NOT NULL "
        "GROUP BY medication ORDER BY prescription_count DESC, medication LIMIT 15"
    ),
)
def topk_min_max(spark, sf_dir):
    return plain(workloads.top_costs(healthcare(spark, sf_dir)), DIGITS)


@register(
    "distinct_per_group",
    with_adult(
        "SELECT education, COUNT(DISTINCT occupation) AS unique_occupations "
        "FROM adult GROUP BY education"
    ),
)
def distinct_per_group(spark, sf_dir):
    return workloads.distinct_by(
        adult(spark, sf_dir), "education", "occupation", "unique_occupations"
    )


@register(
    "distinct_per_group_health",
    with_healthcare(
        "SELECT hospital, COUNT(DISTINCT doctor) AS doctor_count "
        "FROM healthcare GROUP BY hospital ORDER BY doctor_count DESC, hospital"
    ),
)
def distinct_per_group_health(spark, sf_dir):
    return workloads.distinct_by(healthcare(spark, sf_dir), "hospital", "doctor", "doctor_count")


@register(
    "distinct_orders_per_part",
    "SELECT l_partkey, COUNT(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY l_partkey",
)
def distinct_orders_per_part(spark, sf_dir):
    return workloads.distinct_by(
        table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey", "n_orders"
    )


@register(
    "distinct_counts",
    with_adult(
        "SELECT COUNT(DISTINCT age) AS distinct_age, COUNT(DISTINCT education) AS distinct_education, "
        "COUNT(DISTINCT occupation) AS distinct_occupation, "
        "COUNT(DISTINCT native_country) AS distinct_native_country FROM adult"
    ),
)
def distinct_counts(spark, sf_dir):
    return workloads.distinct_counts(
        adult(spark, sf_dir), ("age", "education", "occupation", "native_country")
    )


@register(
    "group_one_key",
    with_adult("SELECT occupation, COUNT(*) AS cnt FROM adult GROUP BY occupation"),
)
def group_one_key(spark, sf_dir):
    return workloads.count_by(adult(spark, sf_dir), "occupation")


@register(
    "avg_by_group",
    with_adult(
        "SELECT education, COUNT(*) AS cnt, "
        "round(CAST(SUM(hours_per_week) AS DOUBLE) / COUNT(hours_per_week), 6) AS avg_hours "
        "FROM adult GROUP BY education"
    ),
)
def avg_by_group(spark, sf_dir):
    return plain(
        workloads.avg_by(adult(spark, sf_dir), "education", "hours_per_week", "avg_hours"), DIGITS
    )


@register(
    "sum_by_group",
    with_adult(
        "SELECT occupation, CAST(SUM(hours_per_week) AS BIGINT) AS total_hours FROM adult "
        "WHERE occupation <> '?' GROUP BY occupation"
    ),
)
def sum_by_group(spark, sf_dir):
    return workloads.sum_by(adult(spark, sf_dir), "occupation", "hours_per_week", "total_hours")


@register(
    "bucket_count",
    "SELECT CAST(CAST(l_quantity AS INTEGER) // 10 * 10 AS INTEGER) AS quantity_bucket, "
    "COUNT(*) AS cnt FROM lineitem GROUP BY 1",
)
def bucket_count(spark, sf_dir):
    from veilframe.functions.masks import bucket

    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(
        bucket(F.col("l_quantity").cast("int"), 10).alias("quantity_bucket")
    ).agg(F.count(F.lit(1)).alias("cnt"))


@register(
    "self_join_olap",
    with_adult(
        "SELECT a.education, CAST(SUM(b.n) AS DOUBLE) AS match_count, "
        "round(CAST(SUM(a.age * b.n) AS DOUBLE) / SUM(b.n), 6) AS avg_age FROM adult a "
        "JOIN (SELECT occupation, COUNT(*) AS n FROM adult WHERE age > 30 GROUP BY occupation) b "
        "ON a.occupation = b.occupation "
        "WHERE a.age > 30 GROUP BY a.education ORDER BY a.education LIMIT 100"
    ),
)
def self_join_olap(spark, sf_dir):
    pairs = workloads.self_join_groups(adult(spark, sf_dir))
    return plain(pairs, DIGITS)


@register(
    "self_join_billing",
    with_healthcare(
        "SELECT a.medical_condition, CAST(SUM(b.n) AS DOUBLE) AS match_count, "
        "round(SUM(CAST(a.billing_amount AS DOUBLE) * b.n) / SUM(b.n), 6) AS avg_billing "
        "FROM healthcare a JOIN (SELECT doctor, COUNT(*) AS n FROM healthcare "
        "WHERE billing_amount > 30 GROUP BY doctor) b ON a.doctor = b.doctor "
        "WHERE a.billing_amount > 30 GROUP BY 1 ORDER BY 1 LIMIT 100"
    ),
)
def self_join_billing(spark, sf_dir):
    """A decimal measure keeps its cents."""
    pairs = workloads.self_join_groups(
        healthcare(spark, sf_dir), group="medical_condition", on="doctor",
        measure="billing_amount", average="avg_billing",
    )
    return plain(pairs, DIGITS)


@register(
    "self_join_olap_parts",
    "SELECT a.p_type, CAST(COUNT(*) AS DOUBLE) AS match_count, "
    "round(CAST(SUM(a.p_size) AS DOUBLE) / COUNT(*), 6) AS avg_age "
    "FROM part a JOIN part b ON a.p_brand = b.p_brand "
    "WHERE a.p_size > 30 AND b.p_size > 30 GROUP BY a.p_type ORDER BY a.p_type LIMIT 100",
)
def self_join_olap_parts(spark, sf_dir):
    pairs = workloads.self_join_groups(
        table(spark, sf_dir, "part"), group="p_type", on="p_brand", measure="p_size"
    )
    return plain(pairs, DIGITS)


# --- recorded measurements -----------------------------------------------------------------------

# Measurement records made of events: the system by id, the workload by type of event.
SYSTEM_OF = ("raw", "view", "static", "dynamic")
WORKLOAD_OF = {
    "view": "point_lookup",
    "click": "range",
    "signup": "groupby",
    "error": "distinct",
    "purchase": "other",
}


def runs(spark, sf_dir, *more):
    """The events as measurement records, beside further columns made of them."""
    e = table(spark, sf_dir, "events")
    system = F.element_at(
        F.array(*[F.lit(s) for s in SYSTEM_OF]), (F.col("event_id") % 4 + 1).cast("int")
    )
    workload = None
    for event, label in WORKLOAD_OF.items():
        test = F.col("event_type") == event
        workload = F.when(test, label) if workload is None else workload.when(test, label)
    return e.select(
        F.concat(system, F.lit("_"), workload).alias("experiment"),
        system.alias("system"),
        (F.col("user_id") % 2).alias("query_idx"),
        F.col("event_id").alias("run"),
        F.col("value").alias("wall_clock_ms"),
        (F.col("user_id") % 50).alias("row_count"),
        *more,
    )


_RUNS = (
    "runs AS (SELECT system || '_' || workload AS experiment, system, query_idx, run, "
    "wall_clock_ms, row_count FROM (SELECT "
    "(['raw', 'view', 'static', 'dynamic'])[CAST(event_id % 4 + 1 AS INTEGER)] AS system, "
    "CASE event_type WHEN 'view' THEN 'point_lookup' WHEN 'click' THEN 'range' "
    "WHEN 'signup' THEN 'groupby' WHEN 'error' THEN 'distinct' "
    "WHEN 'purchase' THEN 'other' END AS workload, "
    "user_id % 2 AS query_idx, event_id AS run, value AS wall_clock_ms, "
    "user_id % 50 AS row_count FROM events))"
)
_SUMMARY = (
    "summary AS (SELECT experiment, system, query_idx, COUNT(*) AS runs, "
    "median(wall_clock_ms) AS wall_clock_median_ms, avg(wall_clock_ms) AS wall_clock_mean_ms, "
    "coalesce(stddev_samp(wall_clock_ms), 0) AS wall_clock_std_ms, "
    "arg_min(row_count, run) AS row_count FROM runs GROUP BY experiment, system, query_idx)"
)
_LABEL = (
    "nullif(regexp_extract(experiment, '_(point_lookup|range|groupby|distinct|topk)', 1), '')"
)


@register(
    "measurement_summary",
    f"WITH {_RUNS}, {_SUMMARY} SELECT experiment, system, query_idx, runs, "
    "round(wall_clock_median_ms, 6) AS wall_clock_median_ms, "
    "round(wall_clock_mean_ms, 6) AS wall_clock_mean_ms, "
    "round(wall_clock_std_ms, 6) AS wall_clock_std_ms, row_count FROM summary",
)
def measurement_summary(spark, sf_dir):
    return plain(report.measurement_summary(runs(spark, sf_dir)), DIGITS)


@register(
    "exact_median",
    "SELECT l_returnflag, round(median(l_extendedprice), 6) AS median FROM lineitem "
    "GROUP BY l_returnflag",
)
def median_by_flag(spark, sf_dir):
    from veilframe.operators.median import exact_median

    return plain(
        exact_median(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice"), DIGITS
    )


@register(
    "exact_median_epoch",
    "SELECT l_returnflag, round(median(CAST(86400 * date_diff('day', DATE '1970-01-01', "
    "CAST(l_shipdate AS DATE)) AS DOUBLE) + l_linenumber), 6) AS median FROM lineitem "
    "GROUP BY l_returnflag",
)
def median_of_seconds(spark, sf_dir):
    """Epoch seconds: a narrow band of values far from zero."""
    from veilframe.operators.median import exact_median

    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    seconds = (days * 86400).cast("double") + F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", seconds.alias("at"))
    return plain(exact_median(lines, ["l_returnflag"], "at"), DIGITS)


@register(
    "exact_median_nan",
    "SELECT l_linenumber, round(median(CASE WHEN l_partkey % 3 = 0 THEN 'nan'::DOUBLE "
    "WHEN l_partkey % 3 = 1 THEN l_discount - l_tax END), 6) AS median FROM lineitem "
    "GROUP BY l_linenumber",
)
def median_with_nan(spark, sf_dir):
    """NaN sorts last, null does not count."""
    from veilframe.operators.median import exact_median

    kind = F.col("l_partkey") % 3
    value = F.when(kind == 0, F.lit(float("nan"))).when(kind == 1, F.col("l_discount") - F.col("l_tax"))
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", value.alias("v"))
    return plain(exact_median(lines, ["l_linenumber"], "v"), DIGITS)


_PIVOT = (
    "pivoted AS (SELECT workload, avg(CASE WHEN system = 'raw' THEN wall_clock_mean_ms END) AS raw, "
    "avg(CASE WHEN system = 'view' THEN wall_clock_mean_ms END) AS view, "
    "avg(CASE WHEN system = 'static' THEN wall_clock_mean_ms END) AS static, "
    "avg(CASE WHEN system = 'dynamic' THEN wall_clock_mean_ms END) AS dynamic "
    f"FROM (SELECT *, {_LABEL} AS workload FROM summary) WHERE workload IS NOT NULL "
    "GROUP BY workload)"
)


@register(
    "latency_pivot",
    f"WITH {_RUNS}, {_SUMMARY}, {_PIVOT} SELECT workload, round(raw, 6) AS raw, "
    "round(view, 6) AS view, round(static, 6) AS static, round(dynamic, 6) AS dynamic FROM pivoted",
)
def latency_pivot(spark, sf_dir):
    summary = report.measurement_summary(runs(spark, sf_dir))
    return plain(report.latency_pivot(summary, "wall_clock_mean_ms"), DIGITS)


@register(
    "overhead_pivot",
    f"WITH {_RUNS}, {_SUMMARY}, {_PIVOT} SELECT workload, "
    "round((view - raw) / raw * 100, 1) AS view, round((static - raw) / raw * 100, 1) AS static, "
    "round((dynamic - raw) / raw * 100, 1) AS dynamic FROM pivoted",
)
def overhead_pivot(spark, sf_dir):
    summary = report.measurement_summary(runs(spark, sf_dir))
    return report.overhead_pivot(summary, "wall_clock_mean_ms")


@register(
    "label_extract",
    f"WITH {_RUNS} SELECT {_LABEL} AS workload, COUNT(*) AS cnt FROM runs GROUP BY 1",
)
def label_extract(spark, sf_dir):
    labelled = runs(spark, sf_dir).select(
        report.workload_label(F.col("experiment")).alias("workload")
    )
    return labelled.groupBy("workload").agg(F.count(F.lit(1)).alias("cnt"))


def plan_records(spark, sf_dir):
    """Plan documents as JSON text: estimated rows from the value, actual rows from props."""
    document = F.concat(
        F.lit('{"Plan": {"Actual Total Time": '),
        F.col("value").cast("string"),
        F.lit(', "Plan Rows": '),
        F.floor("value").cast("string"),
        F.lit(', "Actual Rows": '),
        F.get_json_object("props", "$.k"),
        F.lit('}, "Shared Hit Blocks": '),
        (F.col("user_id") % 7).cast("string"),
        F.lit("}"),
    )
    return runs(spark, sf_dir, document.alias("explain_plan"))


_PLANS = (
    "plans AS (SELECT r.experiment, r.system, r.query_idx, e.value AS actual_time_ms, "
    "CAST(floor(e.value) AS BIGINT) AS estimated_rows, "
    "CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) AS actual_rows, "
    "e.user_id % 7 AS buffer_blocks FROM runs r JOIN events e ON r.run = e.event_id)"
)
_ERROR = (
    "CASE WHEN actual_rows > 0 THEN abs(estimated_rows - actual_rows) / actual_rows::DOUBLE "
    "ELSE 0 END"
)


@register(
    "plan_metrics",
    f"WITH {_RUNS}, {_PLANS} SELECT experiment, system, query_idx, actual_time_ms, "
    f"estimated_rows, actual_rows, round({_ERROR}, 6) AS row_estimate_error, buffer_blocks "
    "FROM plans",
)
def plan_metrics(spark, sf_dir):
    return plain(report.plan_metrics(plan_records(spark, sf_dir)), DIGITS)


@register(
    "estimate_error",
    f"WITH {_RUNS}, {_PLANS} SELECT system, round(avg({_ERROR}), 2) AS row_estimate_error, "
    "round(avg(buffer_blocks), 2) AS buffer_blocks FROM plans GROUP BY system",
)
def estimate_error(spark, sf_dir):
    return report.plan_summary(report.plan_metrics(plan_records(spark, sf_dir)))


# --- workloads over masked tables -------------------------------------------------------------------


@register(
    "row_counts_union",
    with_adult(
        "SELECT 'original' AS table_name, COUNT(*) AS rows FROM adult UNION ALL "
        "SELECT 'hash', COUNT(*) FROM adult UNION ALL SELECT 'partial', COUNT(*) FROM adult "
        "UNION ALL SELECT 'shuffle', COUNT(*) FROM adult UNION ALL "
        "SELECT 'fake', COUNT(*) FROM adult UNION ALL SELECT 'noise', COUNT(*) FROM adult "
        "UNION ALL SELECT 'generalize', COUNT(*) FROM adult"
    ),
)
def row_counts_union(spark, sf_dir):
    from veilframe.plans.variants import masking_variants

    people = adult(spark, sf_dir)
    return workloads.row_counts({"original": people, **masking_variants(people, ["id"])})


def _masked_age(spark, sf_dir):
    return policy.ADULT_VIEW.read(adult(spark, sf_dir), "masked_user")


@register(
    "masked_range_count",
    with_adult("SELECT COUNT(*) AS cnt FROM adult WHERE age // 5 * 5 BETWEEN 25 AND 45"),
)
def masked_range_count(spark, sf_dir):
    return workloads.range_count(_masked_age(spark, sf_dir))


@register(
    "masked_range_pushdown",
    with_adult("SELECT COUNT(*) AS cnt FROM adult WHERE age // 5 * 5 BETWEEN 25 AND 45"),
)
def masked_range_pushdown(spark, sf_dir):
    from veilframe.functions.masks import bucket_between

    people = adult(spark, sf_dir)
    in_range = people.where(bucket_between(F.col("age"), 5, 25, 45))
    return policy.ADULT_VIEW.apply(in_range).agg(F.count(F.lit(1)).alias("cnt"))


@register(
    "masked_point_lookup",
    with_adult(
        "SELECT id, CAST(age // 5 * 5 AS INTEGER) AS age, substr(occupation, 1, 3) || '***' "
        "AS occupation FROM adult WHERE id = 5000"
    ),
)
def masked_point_lookup(spark, sf_dir):
    return workloads.point_lookup(_masked_age(spark, sf_dir), 5000).select(
        "id", "age", "occupation"
    )


# --- distinct counts from stored sketches -----------------------------------------------------------


def _doctor_sketches(spark, sf_dir):
    """Sketches of the doctors per hospital, one part per third of the admissions."""
    patients, path = healthcare(spark, sf_dir), fresh_path(spark, "doctor-sketches")
    for part in range(3):
        rows = patients.where(F.col("id") % 3 == part)
        sketches.store_part(rows, path, f"p{part}", ["hospital"], ["doctor", "name"])
    return sketches.stored(spark, path)


def _near(estimate, exact):
    return F.abs(estimate - exact) <= F.ceil(exact * sketches.relative_error(deviations=4.0))


@register(
    "sketched_distinct",
    with_healthcare(
        "SELECT hospital, COUNT(*) AS rows, COUNT(DISTINCT doctor) AS doctors, "
        "COUNT(DISTINCT name) AS names, TRUE AS near FROM healthcare GROUP BY hospital"
    ),
)
def sketched_distinct(spark, sf_dir):
    """Exact counts, and whether the merged sketches' estimates lie within the error bound."""
    guess = sketches.estimates(_doctor_sketches(spark, sf_dir), ["hospital"], ["doctor", "name"])
    exact = healthcare(spark, sf_dir).groupBy("hospital").agg(
        F.countDistinct("doctor").alias("doctors"), F.countDistinct("name").alias("names")
    )
    near = _near(F.col("doctor"), F.col("doctors")) & _near(F.col("name"), F.col("names"))
    return guess.join(exact, "hospital").select(
        "hospital", "rows", "doctors", "names", near.alias("near")
    )


@register(
    "sketched_cardinality_ratio",
    with_adult(
        "SELECT 'fnlwgt' AS column, TRUE AS near UNION ALL SELECT 'age', TRUE"
    ),
)
def sketched_cardinality_ratio(spark, sf_dir):
    """Ratios of raw and masked distinct values by sketches, compared with the exact ones."""
    people, columns = adult(spark, sf_dir).select("id", "age", "fnlwgt"), ["age", "fnlwgt"]
    masked = people.withColumn("age", F.col("age") - F.col("age") % 10).withColumn(
        "fnlwgt", F.floor(F.col("fnlwgt") / 1000)
    )
    guess = sketches.distinct_ratios(
        sketches.sketch_by(people, [], columns), sketches.sketch_by(masked, [], columns), columns
    )

    def counts(df, name):
        cells = [F.struct(F.lit(c).alias("column"), F.countDistinct(c).alias(name)) for c in columns]
        return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")

    exact = counts(people, "before").join(counts(masked, "after"), "column")
    ratio = F.col("after") / F.col("before")
    bound = ratio * (2 * sketches.relative_error(deviations=4.0)) + F.lit(0.001)
    return guess.join(exact, "column").select(
        "column", (F.abs(F.col("cardinality_ratio") - ratio) <= bound).alias("near")
    )
