"""Masks, policies and masked variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.catalog.base import (
    ADULT_COLUMNS,
    HEALTHCARE_COLUMNS,
    HEALTHCARE_OUT,
    adult,
    healthcare,
    plain,
    projection,
    register,
    sql_company,
    sql_full_name,
    sql_hmac,
    sql_index,
    sql_laplace,
    sql_pick,
    sql_taxonomy,
    sql_uniform,
    table,
    text,
    with_adult,
    with_healthcare,
)
from veilframe.functions import fakes, masks, prf, taxonomy
from veilframe.operators.rank import exact_sample, keyed_rank
from veilframe.operators.shuffle import shuffle_columns
from veilframe.operators.surrogate import apply_mapping, clashes, extend_mapping
from veilframe.operators.surrogate_store import open_store
from veilframe.plans import policy, workloads
from veilframe.plans.variants import masking_variant, sampled_variants
from veilframe.session import fresh_path
from veilframe.sources.files import write_parquet
from veilframe.sources.layout import write_clustered

KEY = "mask-key"
DIGITS = 6


def _draw(label: str, ident: str = "id") -> str:
    return sql_uniform(KEY, label, ident)


def _u(label: str, ident: str = "id", part: int = 0):
    return prf.uniform(KEY, label, F.col(ident), part)


# --- row-local masks ------------------------------------------------------------------------


@register(
    "mask_bucket",
    "SELECT p_partkey, CAST(p_size // 5 * 5 AS INTEGER) AS size_5, "
    "CAST((p_size - 25) // 10 * 10 AS INTEGER) AS signed_10 FROM part",
)
def mask_bucket(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        masks.bucket(F.col("p_size"), 5).alias("size_5"),
        masks.bucket(F.col("p_size") - 25, 10).alias("signed_10"),
    )


@register(
    "mask_taxonomy",
    with_adult(
        f"SELECT id, {sql_taxonomy(taxonomy.VIEW_EDUCATION, 'education')} AS view_education, "
        f"{sql_taxonomy(taxonomy.EDUCATION_LEVEL, 'education')} AS education_level, "
        f"{sql_taxonomy(taxonomy.OCCUPATION_CLASS, 'occupation')} AS occupation_class, "
        f"{sql_taxonomy(taxonomy.COUNTRY_US_OR_OTHER, 'native_country')} AS country FROM adult"
    ),
)
def mask_taxonomy(spark, sf_dir):
    return adult(spark, sf_dir).select(
        "id",
        taxonomy.VIEW_EDUCATION.column(F.col("education")).alias("view_education"),
        taxonomy.EDUCATION_LEVEL.column(F.col("education")).alias("education_level"),
        taxonomy.OCCUPATION_CLASS.column(F.col("occupation")).alias("occupation_class"),
        taxonomy.COUNTRY_US_OR_OTHER.column(F.col("native_country")).alias("country"),
    )


@register(
    "mask_taxonomy_table",
    "SELECT s_suppkey, coalesce(r_name, 'Elsewhere') AS s_nation FROM supplier "
    "LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 20 "
    "LEFT JOIN region ON n_regionkey = r_regionkey",
)
def mask_taxonomy_table(spark, sf_dir):
    """Nation to region through a table; nations it lacks become 'Elsewhere'."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    tree = (
        nation.where(F.col("n_nationkey") < 20)
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("value"),
                F.col("r_name").alias("label"))
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.concat(F.lit("N"), F.col("s_nationkey")).alias("s_nation")
    )
    return taxonomy.generalize_by_table(suppliers, "s_nation", tree, "Elsewhere")


@register(
    "mask_sha256",
    with_adult(
        "SELECT id, sha256(CAST(fnlwgt AS VARCHAR)) AS fnlwgt, sha256(occupation) AS occupation "
        "FROM adult"
    ),
)
def mask_sha256(spark, sf_dir):
    return adult(spark, sf_dir).select(
        "id",
        masks.sha256_hex(F.col("fnlwgt")).alias("fnlwgt"),
        masks.sha256_hex(F.col("occupation")).alias("occupation"),
    )


_LONG_KEY = "a key that is longer than one block of the digest, so that it is hashed first itself"


@register(
    "mask_hmac",
    with_adult(
        f"SELECT id, {sql_hmac('occupation', masks.HMAC_KEY)} AS occupation, "
        f"{sql_hmac('native_country', _LONG_KEY)} AS native_country FROM adult"
    ),
)
def mask_hmac(spark, sf_dir):
    return adult(spark, sf_dir).select(
        "id",
        masks.hmac_sha256_hex(F.col("occupation")).alias("occupation"),
        masks.hmac_sha256_hex(F.col("native_country"), _LONG_KEY).alias("native_country"),
    )


@register(
    "mask_partial",
    with_adult(
        "SELECT id, substr(occupation, 1, 3) || '***' AS prefix_3, "
        "CASE WHEN occupation IS NOT NULL AND occupation <> '?' "
        "THEN substr(occupation, 1, 2) || '***' ELSE occupation END AS prefix_2, "
        "substr(native_country, 1, 2) || '***' AS country FROM adult"
    ),
)
def mask_partial(spark, sf_dir):
    return adult(spark, sf_dir).select(
        "id",
        masks.partial(F.col("occupation"), 3).alias("prefix_3"),
        masks.partial(F.col("occupation"), 2, keep=("?",)).alias("prefix_2"),
        masks.partial(F.col("native_country"), 2).alias("country"),
    )


@register(
    "mask_suppress",
    with_healthcare("SELECT id, CAST(NULL AS VARCHAR) AS room_number FROM healthcare"),
)
def mask_suppress(spark, sf_dir):
    return healthcare(spark, sf_dir).select("id", masks.suppress("string").alias("room_number"))


@register(
    "mask_round_step",
    "SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(12,2)) / 100) * 100 AS DOUBLE) "
    "AS o_totalprice FROM orders",
)
def mask_round_step(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(12,2)")
    return plain(
        table(spark, sf_dir, "orders").select(
            "o_orderkey", masks.round_to_step(price, 100).alias("o_totalprice")
        )
    )


@register(
    "mask_trunc_step",
    "SELECT c_custkey, CAST(CAST(trunc(c_acctbal) AS INTEGER) // 1000 * 1000 AS INTEGER) "
    "AS c_acctbal FROM customer",
)
def mask_trunc_step(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        masks.truncate_to_step(F.col("c_acctbal").cast("int"), 1000).alias("c_acctbal"),
    )


def _noise(column: str, span: float) -> str:
    return (
        f"CAST(greatest(0.0::DOUBLE, {column} + ({_draw(column)} - 0.5::DOUBLE) * {column} "
        f"* {span}::DOUBLE) AS INTEGER)"
    )


_MORE_HOURS = (
    "CAST(greatest(1.0::DOUBLE, hours_per_week + "
    f"({_draw('hours_per_week')} - 0.5::DOUBLE) * 10.0::DOUBLE) AS INTEGER)"
)


@register(
    "mask_noise_proportional",
    with_adult(
        f"SELECT id, {_noise('capital_gain', 0.4)} AS capital_gain, "
        f"{_noise('capital_loss', 0.4)} AS capital_loss FROM adult"
    ),
)
def mask_noise_proportional(spark, sf_dir):
    return policy.ADULT_NOISE.apply(adult(spark, sf_dir)).select(
        "id", "capital_gain", "capital_loss"
    )


@register("mask_noise_additive", with_adult(f"SELECT id, {_MORE_HOURS} AS hours_per_week FROM adult"))
def mask_noise_additive(spark, sf_dir):
    return policy.ADULT_NOISE.apply(adult(spark, sf_dir)).select("id", "hours_per_week")


def _ratio(column: str, label: str, ident: str, ratio: float) -> str:
    return (
        f"CAST({column} AS DOUBLE) * (1.0::DOUBLE + (2.0::DOUBLE * {_draw(label, ident)} "
        f"- 1.0::DOUBLE) * {ratio}::DOUBLE)"
    )


@register(
    "mask_noise_ratio",
    "SELECT c_custkey, "
    f"round({_ratio('c_acctbal', 'acctbal', 'c_custkey', 0.15)}, 6) AS c_acctbal FROM customer",
)
def mask_noise_ratio(spark, sf_dir):
    people = table(spark, sf_dir, "customer")
    moved = masks.ratio_noise(
        F.col("c_acctbal"), _u("acctbal", "c_custkey"), 0.15, people.schema["c_acctbal"].dataType
    )
    return plain(people.select("c_custkey", moved.alias("c_acctbal")), DIGITS)


@register(
    "mask_noise_laplace",
    "SELECT c_custkey, round(c_acctbal + "
    f"{sql_laplace(_draw('acctbal', 'c_custkey'), '(10.0::DOUBLE / 0.5::DOUBLE)')}, 6) "
    "AS c_acctbal FROM customer",
)
def mask_noise_laplace(spark, sf_dir):
    moved = masks.laplace_noise(
        F.col("c_acctbal"), KEY, "acctbal", F.col("c_custkey"), epsilon=0.5, sensitivity=10.0
    )
    return plain(
        table(spark, sf_dir, "customer").select("c_custkey", moved.alias("c_acctbal")), DIGITS
    )


def _random_int(label: str, low: int, high: int) -> str:
    return f"CAST({low - 1} + {sql_index(_draw(label), high - low + 1)} AS INTEGER)"


@register("mask_random_int", with_adult(f"SELECT id, {_random_int('age', 18, 90)} AS age FROM adult"))
def mask_random_int(spark, sf_dir):
    return adult(spark, sf_dir).select("id", masks.random_int(_u("age"), 18, 90).alias("age"))


@register(
    "mask_fake_list",
    with_adult(
        f"SELECT id, {sql_pick(fakes.FAKE_EDUCATION, _draw('education'))} AS education FROM adult"
    ),
)
def mask_fake_list(spark, sf_dir):
    return adult(spark, sf_dir).select(
        "id", masks.fake_from(fakes.FAKE_EDUCATION, _u("education")).alias("education")
    )


@register(
    "mask_fake_name",
    "SELECT c_custkey, " + sql_full_name(KEY, "c_name", "c_custkey") + " AS c_name FROM customer",
)
def mask_fake_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        masks.fake_full_name(_u("c_name", "c_custkey"), _u("c_name", "c_custkey", 1)).alias(
            "c_name"
        ),
    )


@register(
    "mask_fake_company_country",
    with_adult(
        f"SELECT id, {sql_company(KEY, 'occupation', 'id')} AS occupation, "
        f"{sql_pick(fakes.COUNTRIES, _draw('native_country'))} AS native_country FROM adult"
    ),
)
def mask_fake_company_country(spark, sf_dir):
    return policy.ADULT_FAKE.apply(adult(spark, sf_dir)).select(
        "id", "occupation", "native_country"
    )


def _fpe(value: str, key: str) -> str:
    """Character i from byte i of the digest, further digests beyond 32 characters."""
    tail = sql_hmac(f"{value} || '|' || CAST(b AS VARCHAR)", key)
    hexes = (
        f"({sql_hmac(value, key)} || array_to_string([{tail} FOR b IN "
        f"range(1, (length({value}) - 1) // 32 + 1)], ''))"
    )
    return (
        f"array_to_string([substr('{masks.FPE_ALPHABET}', CAST(CAST('0x' || "
        f"substr({hexes}, i * 2 - 1, 2) AS INTEGER) % 36 + 1 AS INTEGER), 1) "
        f"FOR i IN range(1, length({value}) + 1)], '')"
    )


@register(
    "mask_fpe",
    f"SELECT c_custkey, {_fpe('c_name', masks.FPE_KEY)} AS c_name, "
    f"{_fpe('c_mktsegment', 'other-key')} AS c_mktsegment FROM customer",
)
def mask_fpe(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        masks.length_preserving(F.col("c_name")).alias("c_name"),
        masks.length_preserving(F.col("c_mktsegment"), "other-key").alias("c_mktsegment"),
    )


_LONG = "c_name || ' ' || c_mktsegment || ' ' || c_name || ' ' || c_name"


@register(
    "mask_fpe_long",
    f"SELECT c_custkey, {_fpe('long', masks.FPE_KEY)} AS long FROM "
    f"(SELECT c_custkey, {_LONG} AS long FROM customer)",
)
def mask_fpe_long(spark, sf_dir):
    """Texts longer than one digest."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_LONG).alias("long"))
    return customer.withColumn("long", masks.length_preserving(F.col("long")))


# --- jobs: surrogates and shuffle -----------------------------------------------------------------


def _surrogate(column: str, key: str) -> str:
    return f"'SRG-' || substr({sql_hmac(text(column + '|') + ' || ' + column, key)}, 1, 16)"


@register(
    "mask_surrogate",
    with_adult(
        f"SELECT id, {_surrogate('occupation', 'old-key')} AS occupation, "
        f"{_surrogate('native_country', 'srg-key')} AS native_country FROM adult"
    ),
)
def mask_surrogate(spark, sf_dir):
    """A mapping made earlier under another key stays in force when a column is added."""
    people = adult(spark, sf_dir).select("id", "occupation", "native_country")
    earlier = write_parquet(
        extend_mapping(people, ["occupation"], key="old-key"), fresh_path(spark, "surrogates")
    )
    mapping = write_parquet(
        extend_mapping(people, ["occupation", "native_country"], earlier, key="srg-key"),
        fresh_path(spark, "surrogates"),
    )
    return apply_mapping(people, ["occupation", "native_country"], mapping)


_FOUR = ("workclass", "education", "occupation", "native_country")


@register(
    "mask_surrogate_four",
    with_adult(
        "SELECT id, age, "
        + ", ".join(f"{_surrogate(c, 'srg-key')} AS {c}" for c in _FOUR)
        + " FROM adult"
    ),
)
def mask_surrogate_four(spark, sf_dir):
    """Four columns; with few hot keys allowed, broadcast and shuffled lookups both answer."""
    people = adult(spark, sf_dir).select("id", "age", *_FOUR)
    mapping = write_parquet(
        extend_mapping(people, _FOUR, key="srg-key"), fresh_path(spark, "surrogates")
    )
    return apply_mapping(people, _FOUR, mapping, hot_keys=12)


# Values of the first run have the key of that time, those of the second its own.
_SEEN_FIRST = "{0} IN (SELECT {0} FROM adult WHERE id % 3 = 0)"


@register(
    "surrogate_two_runs",
    with_adult(
        "SELECT id, "
        + ", ".join(
            f"CASE WHEN {_SEEN_FIRST.format(c)} THEN {_surrogate(c, 'first-key')} "
            f"ELSE {_surrogate(c, 'second-key')} END AS {c}"
            for c in ("occupation", "fnlwgt")
        )
        + f", {_surrogate('native_country', 'second-key')} AS native_country FROM adult"
    ),
)
def surrogate_two_runs(spark, sf_dir):
    """A stored mapping: a third of the rows first, then all rows and one more column."""
    people = adult(spark, sf_dir).select("id", "occupation", "fnlwgt", "native_country")
    path = fresh_path(spark, "surrogate-store")
    open_store(spark, path, buckets=8).add(
        people.where("id % 3 = 0"), ["occupation", "fnlwgt"], key="first-key"
    )
    store = open_store(spark, path)
    columns = ["occupation", "fnlwgt", "native_country"]
    store.add(people, columns, key="second-key")
    return store.apply(people, columns, hot_keys=100)


@register(
    "surrogate_names",
    f"SELECT c_custkey, {_surrogate('c_name', 'srg-key')} AS c_name FROM customer",
)
def surrogate_names(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    mapping = write_parquet(
        extend_mapping(people, ["c_name"], key="srg-key"), fresh_path(spark, "surrogates")
    )
    return apply_mapping(people, ["c_name"], mapping)


@register(
    "surrogate_clashes",
    f"SELECT {_surrogate('c_name', 'srg-key')} AS surrogate_value, CAST(2 AS BIGINT) AS values "
    "FROM customer WHERE c_custkey % 10 = 0 GROUP BY c_name",
)
def surrogate_clashes(spark, sf_dir):
    """Clashes planted in a mapping, one for every tenth customer, are all found."""
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    sound = extend_mapping(people, ["c_name"], key="srg-key")
    tenth = extend_mapping(people.where("c_custkey % 10 = 0"), ["c_name"], key="srg-key")
    planted = tenth.withColumn("original_value", F.concat(F.lit("other "), "original_value"))
    return clashes(sound.unionByName(planted))


def _moved(column: str) -> str:
    return (
        f"{column}_moved AS (SELECT p.id, v.{column} FROM "
        f"(SELECT id, row_number() OVER (ORDER BY {_draw('place')}, id) AS r FROM adult) p JOIN "
        f"(SELECT {column}, row_number() OVER (ORDER BY {_draw('order.' + column)}, id) AS r "
        "FROM adult) v ON p.r = v.r)"
    )


_SHUFFLED = projection(
    ADULT_COLUMNS,
    {
        "id": "adult.id",
        "occupation": "occupation_moved.occupation",
        "native_country": "native_country_moved.native_country",
    },
)


@register(
    "mask_shuffle",
    with_adult(
        f"SELECT {_SHUFFLED} FROM adult JOIN occupation_moved ON adult.id = occupation_moved.id "
        "JOIN native_country_moved ON adult.id = native_country_moved.id",
        _moved("occupation"),
        _moved("native_country"),
    ),
)
def mask_shuffle(spark, sf_dir):
    return shuffle_columns(adult(spark, sf_dir), ("occupation", "native_country"))


# --- policies ------------------------------------------------------------------------------------------

_ADULT_VIEW = {
    "age": "CAST(age // 5 * 5 AS INTEGER)",
    "fnlwgt": "sha256(CAST(fnlwgt AS VARCHAR))",
    "education": sql_taxonomy(taxonomy.VIEW_EDUCATION, "education"),
    "occupation": "substr(occupation, 1, 3) || '***'",
    "native_country": sql_taxonomy(taxonomy.COUNTRY_US_OR_OTHER, "native_country"),
}
_HEALTH_VIEW = {
    **HEALTHCARE_OUT,
    "name": "substr(name, 1, 2) || '***'",
    "age": "CAST(age // 5 * 5 AS INTEGER)",
    "doctor": "sha256(doctor)",
    "billing_amount": "CAST(round(billing_amount / 100) * 100 AS DOUBLE)",
    "room_number": "CAST(NULL AS VARCHAR)",
}
ADULT_RULES_SQL = {
    "age": _random_int("age", 18, 90),
    "fnlwgt": "CAST(NULL AS INTEGER)",
    "education": sql_pick(fakes.FAKE_EDUCATION, _draw("education")),
    "occupation": sql_company(KEY, "occupation", "id"),
    "native_country": sql_pick(fakes.COUNTRIES, _draw("native_country")),
    "capital_gain": f"CAST({_ratio('capital_gain', 'capital_gain', 'id', 0.2)} AS INTEGER)",
    "capital_loss": f"CAST({_ratio('capital_loss', 'capital_loss', 'id', 0.2)} AS INTEGER)",
}
_HEALTH_RULES = {
    **HEALTHCARE_OUT,
    "name": sql_full_name(KEY, "name", "id"),
    "age": _random_int("age", 18, 90),
    "doctor": sql_full_name(KEY, "doctor", "id"),
    "room_number": "CAST(NULL AS VARCHAR)",
    "billing_amount": "CAST(CAST("
    + _ratio("billing_amount", "billing_amount", "id", 0.15)
    + " AS DECIMAL(10,2)) AS DOUBLE)",
}
VARIANTS_SQL = {
    "hash": {
        "occupation": sql_hmac("occupation", masks.HMAC_KEY),
        "native_country": sql_hmac("native_country", masks.HMAC_KEY),
    },
    "partial": {
        "occupation": "CASE WHEN occupation = '?' THEN occupation "
        "ELSE substr(occupation, 1, 2) || '***' END",
        "native_country": "substr(native_country, 1, 2) || '***'",
    },
    "fake": {
        "occupation": sql_company(KEY, "occupation", "id"),
        "native_country": sql_pick(fakes.COUNTRIES, _draw("native_country")),
    },
    "noise": {
        "capital_gain": _noise("capital_gain", 0.4),
        "capital_loss": _noise("capital_loss", 0.4),
        "hours_per_week": _MORE_HOURS,
    },
    "generalize": {
        "age": "CAST(age // 10 * 10 AS INTEGER)",
        "education": sql_taxonomy(taxonomy.EDUCATION_LEVEL, "education"),
        "occupation": sql_taxonomy(taxonomy.OCCUPATION_CLASS, "occupation"),
        "capital_gain": "CAST(capital_gain // 1000 * 1000 AS INTEGER)",
        "capital_loss": "CAST(capital_loss // 1000 * 1000 AS INTEGER)",
    },
}
ADULT_VIEW_SELECT = f"SELECT {projection(ADULT_COLUMNS, _ADULT_VIEW)} FROM adult"
ADULT_RULES_SELECT = f"SELECT {projection(ADULT_COLUMNS, ADULT_RULES_SQL)} FROM adult"
_HEALTH_VIEW_SELECT = f"SELECT {projection(HEALTHCARE_COLUMNS, _HEALTH_VIEW)} FROM healthcare"
_HEALTH_RULES_SELECT = f"SELECT {projection(HEALTHCARE_COLUMNS, _HEALTH_RULES)} FROM healthcare"


@register(
    "policy_where",
    with_adult(
        "SELECT * FROM view WHERE age BETWEEN 25 AND 45 AND education = 'Some-School' "
        "AND occupation = 'Exe***' AND capital_gain <= 40000",
        f"view AS ({ADULT_VIEW_SELECT})",
    ),
)
def policy_where(spark, sf_dir):
    """Filters on a masked view that reach the raw columns of a table laid out by age."""
    people = write_clustered(
        adult(spark, sf_dir), fresh_path(spark, "adult-by-age"), ["age"], rows_per_group=500
    )
    return policy.ADULT_VIEW.where(
        people,
        policy.Between("age", 25, 45),
        policy.Equals("education", "Some-School"),
        policy.Equals("occupation", "Exe***"),
        policy.Between("capital_gain", 0, 40000),
    )


@register(
    "policy_where_health",
    with_healthcare(
        "SELECT id, name, age, CAST(billing_amount AS DOUBLE) AS billing_amount FROM view "
        "WHERE billing_amount BETWEEN 200 AND 4000 AND name = 'El***'",
        f"view AS ({_HEALTH_VIEW_SELECT})",
    ),
)
def policy_where_health(spark, sf_dir):
    """A range of rounded amounts and a shown beginning of names."""
    seen = policy.HEALTHCARE_VIEW.where(
        healthcare(spark, sf_dir),
        policy.Between("billing_amount", 200, 4000),
        policy.Equals("name", "El***"),
    )
    return plain(seen.select("id", "name", "age", "billing_amount"))


@register("policy_view", with_adult(ADULT_VIEW_SELECT))
def policy_view(spark, sf_dir):
    policy.ADULT_VIEW.view(adult(spark, sf_dir), "adult_masked_view")
    return spark.table("adult_masked_view")


@register("policy_view_health", with_healthcare(_HEALTH_VIEW_SELECT))
def policy_view_health(spark, sf_dir):
    return plain(policy.HEALTHCARE_VIEW.apply(healthcare(spark, sf_dir)))


@register("policy_static", with_adult(ADULT_RULES_SELECT))
def policy_static(spark, sf_dir):
    return policy.ADULT_RULES.store(adult(spark, sf_dir), fresh_path(spark, "adult-static"))


@register("policy_static_health", with_healthcare(_HEALTH_RULES_SELECT))
def policy_static_health(spark, sf_dir):
    return plain(
        policy.HEALTHCARE_RULES.store(
            healthcare(spark, sf_dir), fresh_path(spark, "healthcare-static")
        )
    )


@register(
    "policy_dynamic_masked",
    with_adult(
        "SELECT education, COUNT(*) AS cnt FROM masked WHERE age BETWEEN 25 AND 45 "
        "GROUP BY education",
        f"masked AS ({ADULT_RULES_SELECT})",
    ),
)
def policy_dynamic_masked(spark, sf_dir):
    """The masked role's filter and grouping act on masked values."""
    seen = policy.ADULT_RULES.read(adult(spark, sf_dir), "masked_user")
    return workloads.count_by(seen.where(F.col("age").between(25, 45)), "education")


@register(
    "policy_dynamic_raw",
    with_adult(
        "SELECT education, COUNT(*) AS cnt FROM adult WHERE age BETWEEN 25 AND 45 "
        "GROUP BY education"
    ),
)
def policy_dynamic_raw(spark, sf_dir):
    seen = policy.ADULT_RULES.read(adult(spark, sf_dir), "analyst")
    return workloads.count_by(seen.where(F.col("age").between(25, 45)), "education")


@register(
    "policy_dynamic_health",
    with_healthcare(
        "SELECT name, doctor, age, room_number, billing_amount FROM "
        f"({_HEALTH_RULES_SELECT}) WHERE age BETWEEN 30 AND 50"
    ),
)
def policy_dynamic_health(spark, sf_dir):
    seen = policy.HEALTHCARE_RULES.read(healthcare(spark, sf_dir), "masked_user")
    return plain(
        seen.where(F.col("age").between(30, 50)).select(
            "name", "doctor", "age", "room_number", "billing_amount"
        )
    )


@register(
    "materialized_view",
    with_adult(
        "SELECT age, COUNT(*) AS cnt FROM view GROUP BY age", f"view AS ({ADULT_VIEW_SELECT})"
    ),
)
def materialized_view(spark, sf_dir):
    stored = policy.ADULT_VIEW.store(adult(spark, sf_dir), fresh_path(spark, "adult-matview"))
    return workloads.count_by(stored, "age")


def _variant_query(name: str):
    def run(spark, sf_dir):
        return masking_variant(adult(spark, sf_dir), name)

    return run


_VARIANT_SAMPLE = 50_000


@register(
    "sampled_variants",
    with_adult(
        " UNION ALL ".join(
            f"SELECT {text(name)} AS variant, {columns} FROM "
            f"(SELECT {projection(ADULT_COLUMNS, VARIANTS_SQL[name])} FROM adult)"
            for name in VARIANTS_SQL
            for columns in ("id, age, education, occupation, native_country, capital_gain",)
        )
        + " UNION ALL SELECT 'shuffle' AS variant, adult.id, age, education, "
        "occupation_moved.occupation, native_country_moved.native_country, capital_gain "
        "FROM adult JOIN occupation_moved ON adult.id = occupation_moved.id "
        "JOIN native_country_moved ON adult.id = native_country_moved.id",
        "everyone AS (SELECT * FROM adult)",
    ).replace(
        "WITH adult AS (", "WITH people AS (", 1
    ).replace(
        "everyone AS (SELECT * FROM adult)",
        "adult AS (SELECT * FROM people ORDER BY "
        f"{sql_uniform('variant-key', 'sample', 'id')}, id LIMIT {_VARIANT_SAMPLE}), "
        + _moved("occupation") + ", " + _moved("native_country"),
        1,
    ),
)
def sampled_variants_together(spark, sf_dir):
    """One sample, then the six tables made of it; the sample is the operator."""
    columns = ["id", "age", "education", "occupation", "native_country", "capital_gain"]
    result = None
    for name, variant in sampled_variants(adult(spark, sf_dir), _VARIANT_SAMPLE).items():
        rows = variant.select(F.lit(name).alias("variant"), *columns)
        result = rows if result is None else result.unionByName(rows)
    return result


for _name, _changed in VARIANTS_SQL.items():
    register(
        f"variant_{_name}",
        with_adult(f"SELECT {projection(ADULT_COLUMNS, _changed)} FROM adult"),
    )(_variant_query(_name))


_WORKLOAD = (
    "SELECT {system} AS system, education, income, COUNT(*) AS cnt, "
    "round(CAST(SUM(age) AS DOUBLE) / COUNT(age), 6) AS avg_age FROM {table} "
    "GROUP BY education, income ORDER BY cnt DESC, education, income LIMIT 20"
)


@register(
    "workload_over_masked",
    with_adult(
        " UNION ALL ".join(
            f"SELECT * FROM ({_WORKLOAD.format(system=text(s), table=t)})"
            for s, t in (
                ("raw", "adult"), ("view", "view"), ("static", "masked"), ("dynamic", "masked"),
            )
        ),
        f"view AS ({ADULT_VIEW_SELECT})",
        f"masked AS ({ADULT_RULES_SELECT})",
    ),
)
def workload_over_masked(spark, sf_dir):
    """One workload function over the raw table, the view, a stored copy and a role's reading."""
    people = adult(spark, sf_dir)
    seen = {
        "raw": people,
        "view": policy.ADULT_VIEW.apply(people),
        "static": policy.ADULT_RULES.store(people, fresh_path(spark, "adult-static")),
        "dynamic": policy.ADULT_RULES.read(people, "masked_user"),
    }
    result = None
    for system, frame in seen.items():
        rows = workloads.top_pairs(frame).select(F.lit(system).alias("system"), "*")
        result = rows if result is None else result.unionByName(rows)
    return plain(result, DIGITS)


@register(
    "exact_sample",
    with_adult(f"SELECT * FROM adult ORDER BY {sql_uniform('sample-key', 'sample', 'id')}, id LIMIT 1000"),
)
def sample_people(spark, sf_dir):
    """A thousand people: the sample is the operator."""
    return exact_sample(adult(spark, sf_dir), "id", 1000, "sample-key")


@register(
    "random_row_number",
    with_adult(
        f"SELECT id, row_number() OVER (ORDER BY {sql_uniform('order-key', 'order', 'id')}, id) "
        "AS position FROM adult"
    ),
)
def random_row_number(spark, sf_dir):
    """Every row's position in a random order."""
    people = adult(spark, sf_dir).select("id")
    return keyed_rank(people, "id", "order-key", "order", "position")
