"""k-anonymity, linkage attack, noisy aggregates and utility of masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.catalog.base import (
    ADULT_COLUMNS,
    adult,
    plain,
    projection,
    register,
    sql_laplace,
    sql_taxonomy,
    sql_uniform,
    table,
    text,
    with_adult,
)
from veilframe.catalog.masking import (
    ADULT_RULES_SELECT,
    ADULT_VIEW_SELECT,
    VARIANTS_SQL,
    _moved,
)
from veilframe.functions import masks, taxonomy
from veilframe.operators import dp, kanon, linkage, utility
from veilframe.operators.rank import exact_sample
from veilframe.plans import policy
from veilframe.plans.variants import masking_variant, masking_variants
from veilframe.session import fresh_path, stored_once

DIGITS = 6

# --- k-anonymity -----------------------------------------------------------------------------

_GENERALIZED = (
    "g AS (SELECT *, CAST(floor(age / 5) * 5 AS INTEGER) AS age_generalized, "
    f"{sql_taxonomy(taxonomy.KANON_EDUCATION, 'education')} AS education_generalized FROM adult)"
)
_COMPLETE = (
    "age_generalized IS NOT NULL AND education_generalized IS NOT NULL "
    "AND sex IS NOT NULL AND race IS NOT NULL"
)
_QIS = "age_generalized, education_generalized, sex, race"
_SIZES = f"sizes AS (SELECT {_QIS}, COUNT(*) AS n FROM g WHERE {_COMPLETE} GROUP BY {_QIS})"
_SIZED = (
    "sized AS (SELECT g.*, s.n AS group_rows FROM g LEFT JOIN sizes s ON "
    "g.age_generalized = s.age_generalized AND g.education_generalized = s.education_generalized "
    "AND g.sex = s.sex AND g.race = s.race)"
)
_KS = "ks AS (SELECT unnest([2, 5, 10, 20]) AS k)"


@register(
    "kanon_generalize",
    with_adult(f"SELECT id, age_generalized, education_generalized FROM g", _GENERALIZED),
)
def kanon_generalize(spark, sf_dir):
    return kanon.generalize(adult(spark, sf_dir)).select(
        "id", "age_generalized", "education_generalized"
    )


@register(
    "kanon_check",
    with_adult(
        "SELECT MIN(n) >= 10 AS satisfied, MIN(n) AS min_group, "
        "COUNT(*) FILTER (n < 10) AS violating_groups FROM sizes",
        _GENERALIZED,
        _SIZES,
    ),
)
def kanon_check(spark, sf_dir):
    people = kanon.generalize(adult(spark, sf_dir))
    return kanon.check(kanon.group_sizes(people, kanon.QUASI_IDENTIFIERS), 10)


@register(
    "kanon_suppress",
    with_adult(
        f"SELECT id, {_QIS} FROM sized WHERE group_rows >= 10", _GENERALIZED, _SIZES, _SIZED
    ),
)
def kanon_suppress(spark, sf_dir):
    people = kanon.generalize(adult(spark, sf_dir)).select("id", *kanon.QUASI_IDENTIFIERS)
    return kanon.suppress(people, kanon.QUASI_IDENTIFIERS, 10)


@register(
    "kanon_suppress_cold",
    with_adult(
        f"SELECT id, {_QIS} FROM sized WHERE group_rows >= 10", _GENERALIZED, _SIZES, _SIZED
    ),
)
def kanon_suppress_cold(spark, sf_dir):
    """With only the largest groups broadcast, most rows take the shuffled lookup."""
    people = kanon.generalize(adult(spark, sf_dir)).select("id", *kanon.QUASI_IDENTIFIERS)
    return kanon.suppress(people, kanon.QUASI_IDENTIFIERS, 10, hot_keys=200)


@register(
    "kanon_recheck",
    with_adult(
        "SELECT MIN(n) >= 10 AS satisfied, MIN(n) AS min_group, "
        "COUNT(*) FILTER (n < 10) AS violating_groups FROM "
        f"(SELECT {_QIS}, COUNT(*) AS n FROM sized WHERE group_rows >= 10 GROUP BY {_QIS})",
        _GENERALIZED,
        _SIZES,
        _SIZED,
    ),
)
def kanon_recheck(spark, sf_dir):
    """Suppress, then count the groups of what is left."""
    kept = kanon.anonymous_table(adult(spark, sf_dir), 10, fresh_ids=False)
    return kanon.check(kanon.group_sizes(kept, kanon.QUASI_IDENTIFIERS), 10)


@register(
    "kanon_table",
    with_adult(
        f"SELECT row_number() OVER (ORDER BY id) AS id, {', '.join(kanon.OUTPUT_COLUMNS)} "
        "FROM sized WHERE group_rows >= 5",
        _GENERALIZED,
        _SIZES,
        _SIZED,
    ),
)
def kanon_table(spark, sf_dir):
    return kanon.anonymous_table(adult(spark, sf_dir), 5)


def _sweep_sql(sizes: str, sized: str) -> str:
    return (
        "SELECT k, total.n AS original_rows, total.smallest AS min_group_before, "
        f"(SELECT COUNT(*) FROM {sizes} WHERE n < k) AS violating_groups, "
        f"CAST((SELECT coalesce(SUM(n), 0) FROM {sizes} WHERE n >= k) AS BIGINT) AS final_rows, "
        f"CAST(total.n - (SELECT coalesce(SUM(n), 0) FROM {sizes} WHERE n >= k) AS BIGINT) "
        "AS suppressed_rows, "
        f"round(CAST(total.n - (SELECT coalesce(SUM(n), 0) FROM {sizes} WHERE n >= k) AS DOUBLE) "
        "/ total.n, 6) AS suppression_rate, "
        f"(SELECT MIN(n) FROM {sizes} WHERE n >= k) AS min_group_after, "
        f"(SELECT MIN(n) FROM {sizes} WHERE n >= k) >= k AS satisfied_after "
        f"FROM ks, (SELECT (SELECT COUNT(*) FROM {sized}) AS n, "
        f"(SELECT MIN(n) FROM {sizes}) AS smallest) total"
    )


@register(
    "kanon_sweep",
    with_adult(_sweep_sql("sizes", "adult"), _GENERALIZED, _SIZES, _KS),
)
def kanon_sweep(spark, sf_dir):
    people = kanon.generalize(adult(spark, sf_dir))
    return plain(kanon.sweep(people, kanon.QUASI_IDENTIFIERS), DIGITS)


LINE_QIS = ("quantity", "l_returnflag", "l_linestatus", "year", "month")


def line_groups(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        masks.floor_bucket(F.col("l_quantity").cast("int"), 5).alias("quantity"),
        "l_returnflag",
        "l_linestatus",
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
    )


_LINES = (
    "WITH lines AS (SELECT l_orderkey, CAST(floor(CAST(l_quantity AS INTEGER) / 5) * 5 AS INTEGER) "
    "AS quantity, l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS year, "
    "CAST(month(l_shipdate) AS INTEGER) AS month FROM lineitem), "
    f"line_sizes AS (SELECT {', '.join(LINE_QIS)}, COUNT(*) AS n FROM lines "
    f"GROUP BY {', '.join(LINE_QIS)}), {_KS} "
)


@register("kanon_sweep_lines", _LINES + _sweep_sql("line_sizes", "lines"))
def kanon_sweep_lines(spark, sf_dir):
    return plain(kanon.sweep(line_groups(spark, sf_dir), LINE_QIS), DIGITS)


@register(
    "kanon_suppress_lines",
    _LINES + f"SELECT l_orderkey, {', '.join('lines.' + q for q in LINE_QIS)} FROM lines "
    f"JOIN line_sizes USING ({', '.join(LINE_QIS)}) WHERE n >= 20",
)
def kanon_suppress_lines(spark, sf_dir):
    return kanon.suppress(line_groups(spark, sf_dir), LINE_QIS, 20)


def _utility_sql() -> str:
    def part(name: str, key: str, value: str) -> str:
        return (
            f"SELECT k, {text(name)} AS query, o.key, o.v AS original, m.v AS masked, "
            "m.key_found FROM ks CROSS JOIN "
            f"(SELECT {key} AS key, CAST({value} AS DOUBLE) AS v FROM g GROUP BY {key}) o "
            f"LEFT JOIN (SELECT k AS mk, {key} AS key, CAST({value} AS DOUBLE) AS v, "
            f"true AS key_found FROM sized CROSS JOIN ks WHERE group_rows >= k GROUP BY k, {key}) m "
            "ON k = mk AND o.key IS NOT DISTINCT FROM m.key"
        )

    return (
        "answers AS ("
        + " UNION ALL ".join(
            (
                part("count_by_education", "education_generalized", "COUNT(*)"),
                part("avg_age_by_sex", "sex", "AVG(age_generalized)"),
                part("count_by_income", "income", "COUNT(*)"),
            )
        )
        + "), utility AS (SELECT k, query, "
        "coalesce(avg(abs(original - masked)) FILTER (key_found), 0) AS mae, "
        "sum(CASE WHEN original > 0 THEN abs(original - coalesce(masked, 0)) / original "
        "ELSE 0 END) / count(*) AS relative_error FROM answers GROUP BY k, query "
        "HAVING bool_or(key_found))"
    )


@register(
    "kanon_query_utility",
    with_adult(
        "SELECT k, query, round(mae, 4) AS mae, round(relative_error, 6) AS relative_error "
        "FROM utility",
        _GENERALIZED, _SIZES, _SIZED, _KS, _utility_sql(),
    ),
)
def kanon_query_utility(spark, sf_dir):
    return kanon.query_utility(kanon.generalize(adult(spark, sf_dir))).select(
        "k", "query", F.round("mae", 4).alias("mae"),
        F.round("relative_error", 6).alias("relative_error"),
    )


@register(
    "kanon_mean_utility",
    with_adult(
        "SELECT k, round(avg(mae), 4) AS mae, round(avg(relative_error), 6) AS relative_error "
        "FROM utility GROUP BY k",
        _GENERALIZED, _SIZES, _SIZED, _KS, _utility_sql(),
    ),
)
def kanon_mean_utility(spark, sf_dir):
    mean = kanon.mean_utility(kanon.query_utility(kanon.generalize(adult(spark, sf_dir))))
    return mean.select(
        "k", F.round("mae", 4).alias("mae"), F.round("relative_error", 6).alias("relative_error")
    )


def _loss_sql(column: str) -> str:
    return (
        f"SELECT k, {text(column)} AS \"column\", "
        f"(SELECT COUNT(DISTINCT {column}) FROM g) AS original, "
        f"(SELECT COUNT(DISTINCT {column}) FROM sized WHERE group_rows >= k) AS kept FROM ks"
    )


@register(
    "kanon_cardinality_loss",
    with_adult(
        'SELECT k, "column", original, kept, '
        "round(1 - CAST(kept AS DOUBLE) / original, 6) AS loss FROM ("
        + " UNION ALL ".join(_loss_sql(c) for c in kanon.QUASI_IDENTIFIERS)
        + ")",
        _GENERALIZED, _SIZES, _SIZED, _KS,
    ),
)
def kanon_cardinality_loss(spark, sf_dir):
    people = kanon.generalize(adult(spark, sf_dir))
    return plain(kanon.cardinality_loss(people, kanon.QUASI_IDENTIFIERS), DIGITS)


@register(
    "kanon_publish",
    with_adult(
        "SELECT k, (SELECT COUNT(*) FROM adult) AS original_rows, "
        "COUNT(*) FILTER (group_rows >= k) AS final_rows, "
        "COUNT(*) - COUNT(*) FILTER (group_rows >= k) AS suppressed_rows, "
        "round((COUNT(*) - COUNT(*) FILTER (group_rows >= k)) / COUNT(*)::DOUBLE, 6) "
        "AS suppression_rate, "
        "(SELECT round(avg(mae), 4) FROM utility u WHERE u.k = ks.k) AS mae, "
        "(SELECT round(avg(relative_error), 6) FROM utility u WHERE u.k = ks.k) AS relative_error, "
        "COUNT(*) FILTER (group_rows >= k) AS stored_rows, "
        "CASE WHEN COUNT(*) FILTER (group_rows >= k) > 0 THEN "
        "COUNT(*) FILTER (group_rows >= k) END AS last_id "
        "FROM sized CROSS JOIN ks GROUP BY k",
        _GENERALIZED, _SIZES, _SIZED, _KS, _utility_sql(),
    ),
)
def kanon_publish(spark, sf_dir):
    """The report, beside row count and last id of the tables it wrote."""
    folder = fresh_path(spark, "kanon")
    report = kanon.publish(adult(spark, sf_dir), folder)
    stored = None
    for k in kanon.K_VALUES:
        rows = kanon.published(spark, folder, k).agg(
            F.lit(k).alias("k"), F.count(F.lit(1)).alias("stored_rows"), F.max("id").alias("last_id")
        )
        stored = rows if stored is None else stored.unionByName(rows)
    return report.join(stored, "k").select(
        "k", "original_rows", "final_rows", "suppressed_rows",
        F.round("suppression_rate", 6).alias("suppression_rate"),
        F.round("mae", 4).alias("mae"), F.round("relative_error", 6).alias("relative_error"),
        "stored_rows", "last_id",
    )


# --- linkage attack ------------------------------------------------------------------------------------

_MATCH = " AND ".join(f"t.{q} IS NOT DISTINCT FROM e.{q}" for q in linkage.QUASI_IDENTIFIERS)


def _attack_sql(name: str, target: str) -> str:
    matched = "SUM(CASE WHEN hit THEN 1 ELSE 0 END)"
    unique = "SUM(CASE WHEN n = 1 AND hit THEN 1 ELSE 0 END)"
    false = "SUM(CASE WHEN n = 1 AND NOT hit THEN 1 ELSE 0 END)"
    return (
        f"SELECT {text(name)} AS masking_method, "
        f"round({matched}::DOUBLE / COUNT(*), 6) AS match_rate, "
        f"round({unique}::DOUBLE / COUNT(*), 6) AS unique_match_rate, "
        f"round({false}::DOUBLE / COUNT(*), 6) AS false_match_rate, "
        f"COUNT(*) AS total_records, CAST({matched} AS BIGINT) AS matched, "
        f"CAST({unique} AS BIGINT) AS unique_matched, CAST({false} AS BIGINT) AS false_matched, "
        "CAST(NULL AS VARCHAR) AS error FROM "
        "(SELECT e.id, COUNT(t.id) AS n, coalesce(bool_or(t.id = e.id), false) AS hit "
        f"FROM external e LEFT JOIN {target} t ON {_MATCH} GROUP BY e.id)"
    )


_EVERYONE = "external AS (SELECT id, age, education, sex, race FROM adult)"
_SAMPLE = (
    "external AS (SELECT id, age, education, sex, race FROM adult "
    f"ORDER BY {sql_uniform('external-key', 'sample', 'id')}, id LIMIT 1000)"
)


@register(
    "linkage_attack",
    with_adult(_attack_sql("raw", "adult"), _EVERYONE),
)
def linkage_attack(spark, sf_dir):
    """Every person of the table as external data, against the raw table."""
    people = adult(spark, sf_dir)
    return plain(linkage.linkage_attack(people, people, "raw"), DIGITS)


@register(
    "linkage_attack_view",
    with_adult(_attack_sql("view_masked", "view"), _EVERYONE, f"view AS ({ADULT_VIEW_SELECT})"),
)
def linkage_attack_view(spark, sf_dir):
    people = adult(spark, sf_dir)
    return plain(
        linkage.linkage_attack(people, policy.ADULT_VIEW.apply(people), "view_masked"), DIGITS
    )


_VARIANT_CTES = [
    f"{name}_t AS (SELECT {projection(ADULT_COLUMNS, VARIANTS_SQL[name])} FROM adult)"
    for name in ("hash", "partial", "generalize")
]


@register(
    "linkage_sweep",
    with_adult(
        " UNION ALL ".join(
            _attack_sql(name, target)
            for name, target in (
                ("raw", "adult"), ("view_masked", "view"), ("static_masked", "masked"),
                ("hash", "hash_t"), ("partial", "partial_t"), ("shuffle", "adult"),
                ("generalize", "generalize_t"),
            )
        ),
        _SAMPLE,
        f"view AS ({ADULT_VIEW_SELECT})",
        f"masked AS ({ADULT_RULES_SELECT})",
        *_VARIANT_CTES,
    ),
)
def linkage_sweep(spark, sf_dir):
    people = adult(spark, sf_dir)
    people_outside = people.select("id", *linkage.QUASI_IDENTIFIERS)
    external = stored_once(exact_sample(people_outside, "id", 1000, "external-key"), "external")
    targets = {
        "raw": people,
        "view_masked": policy.ADULT_VIEW.apply(people),
        "static_masked": policy.ADULT_RULES.apply(people),
        "hash": masking_variant(people, "hash"),
        "partial": masking_variant(people, "partial"),
        # The attack reads no shuffled column, so nothing is shuffled for it.
        "shuffle": masking_variant(people, "shuffle", ["id", *linkage.QUASI_IDENTIFIERS]),
        "generalize": masking_variant(people, "generalize"),
    }
    return plain(linkage.linkage_sweep(external, targets, external_rows=1000), DIGITS)


@register(
    "linkage_generalized_external",
    with_adult(
        _attack_sql("generalize", "generalize_t"),
        f"generalize_t AS (SELECT {projection(ADULT_COLUMNS, VARIANTS_SQL['generalize'])} "
        "FROM adult)",
        "external AS (SELECT id, age, education, sex, race FROM generalize_t)",
    ),
)
def linkage_generalized_external(spark, sf_dir):
    """An attacker who generalizes their own data as the target was, for everyone."""
    target = policy.ADULT_GENERALIZE.apply(adult(spark, sf_dir))
    return plain(linkage.linkage_attack(target, target, "generalize"), DIGITS)


@register(
    "linkage_other_types",
    with_adult(
        _attack_sql("as_double", "target"),
        _EVERYONE,
        "target AS (SELECT id, CAST(age AS DOUBLE) AS age, education, sex, race FROM adult)",
    ),
)
def linkage_other_types(spark, sf_dir):
    """A mask that only changes a column's type protects nobody."""
    people = adult(spark, sf_dir)
    target = people.withColumn("age", F.col("age").cast("double"))
    return plain(linkage.linkage_attack(people, target, "as_double"), DIGITS)


@register(
    "linkage_failing_target",
    with_adult(
        _attack_sql("raw", "adult")
        + " UNION ALL SELECT 'narrow', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, CAST(0 AS BIGINT), "
        "CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), "
        "'target narrow lacks [''race'', ''sex'']'",
        _EVERYONE,
    ),
)
def linkage_failing_target(spark, sf_dir):
    """A target without the needed columns reports zeros and its error beside the others."""
    people = adult(spark, sf_dir)
    targets = {"raw": people, "narrow": people.select("id", "age", "education")}
    return plain(linkage.linkage_sweep(people, targets), DIGITS)


_PART_EXTERNAL = (
    "WITH external AS (SELECT p_partkey AS id, p_size, p_type, p_brand FROM part), "
    "target AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size % 50 + 1 "
    "ELSE p_size END AS p_size, p_type, nullif(p_brand, 'Brand#2') AS p_brand FROM part) "
)


@register(
    "linkage_attack_parts",
    _PART_EXTERNAL
    + _attack_sql("parts", "target").replace(
        _MATCH, " AND ".join(f"t.{q} IS NOT DISTINCT FROM e.{q}" for q in ("p_size", "p_type", "p_brand"))
    ),
)
def linkage_attack_parts(spark, sf_dir):
    """Finer identifiers, some changed and some suppressed: unique and false matches occur."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    size = F.when(F.col("id") % 3 == 0, F.col("p_size") % 50 + 1).otherwise(F.col("p_size"))
    target = part.withColumn("p_size", size).withColumn(
        "p_brand", F.nullif(F.col("p_brand"), F.lit("Brand#2"))
    )
    return plain(
        linkage.linkage_attack(part, target, "parts", ("p_size", "p_type", "p_brand")), DIGITS
    )


# --- noisy aggregates -------------------------------------------------------------------------------------

_EPS = "eps AS (SELECT unnest([0.1, 0.5, 1.0, 5.0]::DOUBLE[]) AS epsilon)"


def _dp_noise(label: str, group: str, sensitivity: float, share: float = 1.0) -> str:
    ident = f"coalesce(CAST({group} AS VARCHAR), '') || '|' || CAST(epsilon AS VARCHAR)"
    draw = sql_uniform("dp-key", label, f"({ident})")
    return sql_laplace(draw, f"({sensitivity}::DOUBLE / (epsilon * {share}::DOUBLE))")


_COUNT = (
    "noisy_count AS (SELECT age_bucket, cnt, epsilon, greatest(0.0::DOUBLE, cnt + "
    f"{_dp_noise('count', 'age_bucket', 1.0)}) AS cnt_noised FROM "
    "(SELECT CAST(age // 10 * 10 AS INTEGER) AS age_bucket, COUNT(*) AS cnt FROM adult GROUP BY 1), "
    "eps)"
)
_AVG = (
    "noisy_avg AS (SELECT education, cnt, avg_gain, epsilon, "
    f"(avg_gain * cnt + {_dp_noise('sum', 'education', 100000.0, 0.5)}) / "
    f"greatest(1.0::DOUBLE, cnt + {_dp_noise('rows', 'education', 1.0, 0.5)}) AS avg_gain_noised "
    "FROM (SELECT education, COUNT(*) AS cnt, CAST(SUM(capital_gain) AS DOUBLE) / "
    "COUNT(capital_gain) AS avg_gain FROM adult WHERE education <> '?' GROUP BY education), eps)"
)
_SUM = (
    "noisy_sum AS (SELECT occupation, total_hours, epsilon, greatest(0.0::DOUBLE, total_hours + "
    f"{_dp_noise('total', 'occupation', 100.0)}) AS total_hours_noised FROM "
    "(SELECT occupation, CAST(SUM(hours_per_week) AS BIGINT) AS total_hours FROM adult "
    "WHERE occupation <> '?' GROUP BY occupation ORDER BY total_hours DESC, occupation LIMIT 10), "
    "eps)"
)


@register(
    "dp_count",
    with_adult(
        "SELECT age_bucket, cnt, epsilon, round(cnt_noised, 4) AS cnt_noised FROM noisy_count",
        _EPS, _COUNT,
    ),
)
def dp_count(spark, sf_dir):
    return plain(dp.noisy_count(adult(spark, sf_dir), key="dp-key"), 4)


@register(
    "dp_avg",
    with_adult(
        "SELECT education, cnt, round(avg_gain, 4) AS avg_gain, epsilon, "
        "round(avg_gain_noised, 4) AS avg_gain_noised FROM noisy_avg",
        _EPS, _AVG,
    ),
)
def dp_avg(spark, sf_dir):
    return plain(dp.noisy_avg(adult(spark, sf_dir), key="dp-key"), 4)


@register(
    "dp_sum_topk",
    with_adult(
        "SELECT occupation, total_hours, epsilon, "
        "round(total_hours_noised, 4) AS total_hours_noised FROM noisy_sum",
        _EPS, _SUM,
    ),
)
def dp_sum_topk(spark, sf_dir):
    return plain(dp.noisy_sum(adult(spark, sf_dir), key="dp-key"), 4)


_CLIP = 100.0


@register(
    "dp_avg_clipped",
    with_adult(
        "SELECT education, cnt, round(avg_gain, 4) AS avg_gain, epsilon, "
        "round(avg_gain_noised, 4) AS avg_gain_noised FROM noisy_avg",
        _EPS,
        "clipped AS (SELECT education, CASE WHEN capital_loss IS NOT NULL THEN "
        f"greatest(least(CAST(capital_loss AS DOUBLE), {_CLIP}::DOUBLE), -{_CLIP}::DOUBLE) END "
        "AS capital_gain FROM adult)",
        _AVG.replace("FROM adult", "FROM clipped").replace("100000.0", f"{_CLIP}"),
    ),
)
def dp_avg_clipped(spark, sf_dir):
    """Bounded mean of a column with NULLs, which stay out of the sum."""
    return plain(
        dp.noisy_avg(
            adult(spark, sf_dir), measure="capital_loss", sensitivity=_CLIP, clip=_CLIP, key="dp-key"
        ),
        4,
    )


@register(
    "dp_sum_clipped",
    with_adult(
        "SELECT occupation, round(total_hours, 4) AS total_hours, epsilon, "
        "round(total_hours_noised, 4) AS total_hours_noised FROM noisy_sum",
        _EPS,
        _SUM.replace("CAST(SUM(hours_per_week) AS BIGINT)", "CAST(SUM(CASE WHEN capital_loss IS "
        f"NOT NULL THEN greatest(least(CAST(capital_loss AS DOUBLE), {_CLIP}::DOUBLE), "
        f"-{_CLIP}::DOUBLE) END) AS DOUBLE)"),
    ),
)
def dp_sum_clipped(spark, sf_dir):
    return plain(
        dp.noisy_sum(adult(spark, sf_dir), measure="capital_loss", clip=_CLIP, key="dp-key"), 4
    )


def _accuracy(source: str, name: str, true: str, noised: str, offset: str = "") -> str:
    return (
        f"SELECT {text(name)} AS query, epsilon, round(avg(abs({true} - {noised})), 4) AS mae, "
        f"round(avg(abs({true} - {noised}) / ({true}{offset})), 4) AS relative_error "
        f"FROM {source} GROUP BY epsilon"
    )


@register(
    "dp_accuracy",
    with_adult(
        " UNION ALL ".join(
            (
                _accuracy("noisy_count", dp.COUNT_QUERY, "cnt", "cnt_noised"),
                _accuracy("noisy_avg", dp.AVG_QUERY, "avg_gain", "avg_gain_noised", " + 1"),
                _accuracy("noisy_sum", dp.SUM_QUERY, "total_hours", "total_hours_noised"),
            )
        ),
        _EPS, _COUNT, _AVG, _SUM,
    ),
)
def dp_accuracy(spark, sf_dir):
    return plain(dp.accuracy_sweep(adult(spark, sf_dir), key="dp-key"), 4)


@register(
    "dp_count_lines",
    "WITH eps AS (SELECT unnest([0.1, 0.5, 1.0, 5.0]::DOUBLE[]) AS epsilon) "
    "SELECT age_bucket, cnt, epsilon, round(greatest(0.0::DOUBLE, cnt + "
    f"{_dp_noise('count', 'age_bucket', 1.0)}), 4) AS cnt_noised FROM "
    "(SELECT CAST(CAST(l_quantity AS INTEGER) // 10 * 10 AS INTEGER) AS age_bucket, "
    "COUNT(*) AS cnt FROM lineitem GROUP BY 1), eps",
)
def dp_count_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("age"))
    return plain(dp.noisy_count(lines, key="dp-key"), 4)


# --- utility of masks -----------------------------------------------------------------------------------------


def _distance_sql(source: str, column: str = "occupation") -> str:
    counts = f"SELECT {column} AS v, COUNT(*)::DOUBLE AS n FROM {{}} WHERE {column} IS NOT NULL GROUP BY 1"
    return (
        "(SELECT sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + "
        "CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 0)) FROM ("
        f"SELECT coalesce(a.n, 0) / (SELECT COUNT({column}) FROM adult) AS p, "
        f"coalesce(b.n, 0) / (SELECT COUNT({column}) FROM {source}) AS q FROM "
        f"({counts.format('adult')}) a FULL JOIN ({counts.format(source)}) b ON a.v = b.v))"
    )


def _ratio_sql(source: str, column: str = "occupation") -> str:
    return (
        f"(SELECT COUNT(DISTINCT {column}) FROM {source})::DOUBLE / "
        f"(SELECT COUNT(DISTINCT {column}) FROM adult)"
    )


_ALL_VARIANTS = {
    "hash": "hash_t", "partial": "partial_t", "shuffle": "occupation_moved", "fake": "fake_t",
    "noise": "adult", "generalize": "generalize_t",
}
_UTILITY_CTES = [
    *_VARIANT_CTES,
    f"fake_t AS (SELECT {projection(ADULT_COLUMNS, VARIANTS_SQL['fake'])} FROM adult)",
    _moved("occupation"),
]


@register(
    "cardinality_ratio",
    with_adult(
        "SELECT (SELECT COUNT(DISTINCT occupation) FROM adult) AS original_distinct, "
        "(SELECT COUNT(DISTINCT occupation) FROM generalize_t) AS masked_distinct, "
        f"round({_ratio_sql('generalize_t')}, 6) AS cardinality_ratio",
        *_VARIANT_CTES,
    ),
)
def cardinality_ratio(spark, sf_dir):
    people = adult(spark, sf_dir)
    return plain(
        utility.cardinality_ratio(people, policy.ADULT_GENERALIZE.apply(people), "occupation"),
        DIGITS,
    )


@register(
    "js_distance",
    with_adult(
        f"SELECT round({_distance_sql('partial_t', 'native_country')}, 6) AS js_distance",
        *_VARIANT_CTES,
    ),
)
def js_distance(spark, sf_dir):
    people = adult(spark, sf_dir)
    return plain(
        utility.js_distance(people, policy.ADULT_PARTIAL.apply(people), "native_country"), DIGITS
    )


@register(
    "mask_comparison",
    with_adult(
        " UNION ALL ".join(
            f"SELECT {text(name)} AS masking_function, round({_ratio_sql(t)}, 3) "
            f"AS cardinality_ratio, round({_distance_sql(t)}, 3) AS js_distance"
            for name, t in _ALL_VARIANTS.items()
        ),
        *_UTILITY_CTES,
    ),
)
def mask_comparison(spark, sf_dir):
    people = adult(spark, sf_dir)
    return utility.comparison_report(people, masking_variants(people, ["id", "occupation"]))
