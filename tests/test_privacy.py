"""k-anonymity, linkage, noisy aggregates, utility on small tables."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilframe.operators import dp, kanon, linkage, lookup, utility

QIS = ("a", "b")


def groups_table(spark, sizes):
    rows, i = [], 0
    for (a, b), n in sizes.items():
        for _ in range(n):
            rows.append((i, a, b, "hi" if i % 3 else "lo", i % 40))
            i += 1
    return spark.createDataFrame(rows, "id int, a string, b string, income string, age int")


SIZES = {("x", "p"): 4, ("x", "q"): 5, ("y", "p"): 6, ("y", None): 9, (None, "p"): 7, ("z", "q"): 1}


def test_check_and_suppress_at_the_border(spark):
    df = groups_table(spark, SIZES)
    sizes = kanon.group_sizes(df, QIS)
    assert tuple(kanon.check(sizes, 5).first()) == (False, 1, 2)
    kept = kanon.suppress(df, QIS, 5)
    assert Counter((r.a, r.b) for r in kept.collect()) == {("x", "q"): 5, ("y", "p"): 6}
    assert tuple(kanon.check(kanon.group_sizes(kept, QIS), 5).first()) == (True, 5, 0)


@pytest.mark.parametrize("hot_keys", [2, 1000])
def test_suppress_with_a_hot_group(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(lookup, "HOT_KEYS", hot_keys)
    df = groups_table(spark, {("h", "h"): 400, **{(f"g{i}", "p"): i % 7 + 1 for i in range(60)}})
    kept = kanon.suppress(df, QIS, 4)
    counts = Counter((r.a, r.b) for r in kept.collect())
    want = {("h", "h"): 400, **{(f"g{i}", "p"): i % 7 + 1 for i in range(60) if i % 7 + 1 >= 4}}
    assert counts == want


def test_all_groups_too_small_and_empty_table(spark):
    df = groups_table(spark, SIZES)
    assert kanon.suppress(df, QIS, 100).count() == 0
    assert kanon.suppress(df.limit(0), QIS, 2).count() == 0
    row = kanon.sweep(df.limit(0), QIS, [2]).first()
    assert (row.original_rows, row.final_rows, row.suppression_rate) == (0, 0, None)


def test_sweep_agrees_with_suppression(spark):
    df = groups_table(spark, SIZES)
    rows = {r.k: r for r in kanon.sweep(df, QIS, [2, 5, 6, 50]).collect()}
    for k, r in rows.items():
        assert r.original_rows == 32
        assert r.final_rows == kanon.suppress(df, QIS, k).count()
        assert r.suppressed_rows == r.original_rows - r.final_rows
    assert rows[5].min_group_after == 5 and rows[5].satisfied_after
    assert rows[50].final_rows == 0 and rows[50].min_group_after is None


def test_query_utility_against_plain_python(spark):
    df = groups_table(spark, SIZES)
    queries = (
        kanon.GroupQuery("by_a", "a"),
        kanon.GroupQuery("age_by_b", "b", "age"),
        kanon.GroupQuery("by_income", "income"),
    )
    got = {
        (r.k, r.query): (r.mae, r.relative_error)
        for r in kanon.query_utility(df, QIS, queries, [2, 6, 50]).collect()
    }
    rows = [r.asDict() for r in df.collect()]
    sizes = Counter((r["a"], r["b"]) for r in rows if r["a"] and r["b"])
    want = {}
    for k in (2, 6):
        kept = [r for r in rows if sizes.get((r["a"], r["b"]), 0) >= k]
        for q in queries:
            def answer(data):
                out = {}
                for r in data:
                    out.setdefault(r[q.key], []).append(r[q.measure] if q.measure else 1)
                return {
                    key: (sum(v) / len(v) if q.measure else float(sum(v)))
                    for key, v in out.items()
                }
            original, masked = answer(rows), answer(kept)
            gaps = [abs(original[x] - masked[x]) for x in original if x in masked]
            relative = sum(
                abs(v - masked.get(x, 0)) / v for x, v in original.items() if v > 0
            ) / len(original)
            want[(k, q.name)] = (sum(gaps) / len(gaps), relative)
    assert set(got) == set(want)
    for key in want:
        assert got[key] == pytest.approx(want[key])


def test_cardinality_loss(spark):
    df = groups_table(spark, SIZES)
    got = {(r.k, r.column): (r.original, r.kept, r.loss) for r in
           kanon.cardinality_loss(df, QIS, [5, 50]).collect()}
    assert got[(5, "a")] == (3, 2, pytest.approx(1 / 3))
    assert got[(50, "b")] == (2, 0, 1.0)


# --- linkage ------------------------------------------------------------------------------


def brute_attack(external, target, qis):
    matched = unique = false = 0
    for e in external:
        hits = [t["id"] for t in target if all(t[q] == e[q] for q in qis)]
        if len(hits) == 1:
            if hits[0] == e["id"]:
                matched += 1
                unique += 1
            else:
                false += 1
        elif e["id"] in hits:
            matched += 1
    return len(external), matched, unique, false


@pytest.mark.parametrize("bound", [None, 60])
def test_linkage_equals_brute_force(spark, bound):
    rng = random.Random(3)
    schema = "id bigint, age int, education string"
    qis = ("age", "education")

    def people(ids):
        return [
            (i, rng.choice([20, 21, 22, 23, None]), rng.choice(["a", "b", "c", None])) for i in ids
        ]

    target = people(range(40)) + [(100 + i, 20, "hot") for i in range(200)]
    external = target[:30] + people(range(500, 520)) + [(100, 20, "hot"), (7_000, 23, "only")]
    target.append((7_001, 23, "only"))
    e, t = spark.createDataFrame(external, schema), spark.createDataFrame(target, schema)
    row = linkage.linkage_attack(e, t, "t", qis, external_rows=bound).first()
    names = ("id", *qis)
    want = brute_attack(
        [dict(zip(names, r)) for r in external], [dict(zip(names, r)) for r in target], qis
    )
    assert (row.total_records, row.matched, row.unique_matched, row.false_matched) == want
    assert row.match_rate == pytest.approx(want[1] / want[0])


def test_linkage_on_itself_and_sweep_with_a_failing_target(spark):
    df = groups_table(spark, SIZES)
    rows = {
        r.masking_method: r
        for r in linkage.linkage_sweep(
            df, {"raw": df, "gone": df.drop("b"), "nobody": df.limit(0)}, QIS
        ).collect()
    }
    assert rows["raw"].match_rate == 1.0 and rows["raw"].error is None
    assert rows["raw"].unique_matched == 1
    assert rows["gone"].match_rate == 0.0 and "b" in rows["gone"].error
    assert rows["nobody"].matched == 0 and rows["nobody"].total_records == 32


# --- noisy aggregates ------------------------------------------------------------------------


def people(spark, n=3000):
    return spark.range(n).select(
        "id",
        (F.col("id") % 70 + 18).cast("int").alias("age"),
        F.concat(F.lit("e"), F.col("id") % 5).alias("education"),
        (F.col("id") % 1000).cast("int").alias("capital_gain"),
        F.when(F.col("id") % 13 == 0, "?").otherwise(F.concat(F.lit("o"), F.col("id") % 12)).alias(
            "occupation"
        ),
        (F.col("id") % 60 + 1).cast("int").alias("hours_per_week"),
    )


def test_noise_shrinks_with_epsilon_and_never_goes_below_zero(spark):
    rows = dp.accuracy_sweep(people(spark), epsilons=(0.01, 100.0), key="k").collect()
    by = {(r.query, r.epsilon): r.mae for r in rows}
    for query in (dp.COUNT_QUERY, dp.AVG_QUERY, dp.SUM_QUERY):
        assert by[(query, 0.01)] > by[(query, 100.0)]
    tiny = dp.noisy_count(people(spark, 20), epsilons=(0.001,), key="k")
    assert tiny.where("cnt_noised < 0").count() == 0


def test_noisy_sum_takes_top_groups_without_unknown(spark):
    got = dp.noisy_sum(people(spark), epsilons=(1.0,), top=10, key="k")
    assert got.count() == 10 and got.where("occupation = '?'").count() == 0


def test_clip_bounds_the_input(spark):
    got = dp.noisy_sum(people(spark), epsilons=(1.0,), clip=1.0, top=50, key="k")
    counts = people(spark).where("occupation <> '?'").groupBy("occupation").count()
    want = {r.occupation: r["count"] for r in counts.collect()}
    assert {r.occupation: r.total_hours for r in got.collect()} == want


def test_another_key_gives_other_noise(spark):
    a = dp.noisy_count(people(spark), epsilons=(1.0,), key="a").collect()
    b = dp.noisy_count(people(spark), epsilons=(1.0,), key="b").collect()
    assert {r.cnt_noised for r in a}.isdisjoint({r.cnt_noised for r in b})


# --- utility ----------------------------------------------------------------------------------


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def test_distance_of_equal_disjoint_and_empty(spark):
    a = column(spark, ["x", "x", "y", None])
    got = {
        r.name: r
        for r in utility.compare_distributions(
            a,
            {
                "same": column(spark, ["y", "x", "x"]),
                "other": column(spark, ["p", "q"]),
                "none": column(spark, [None]),
                "half": column(spark, ["x", "y"]),
            },
            "v",
        ).collect()
    }
    assert got["same"].js_distance == pytest.approx(0.0, abs=1e-9)
    assert got["other"].js_distance == pytest.approx(math.sqrt(math.log(2)))
    assert got["none"].js_distance is None and got["none"].cardinality_ratio == 0.0
    p, q = (2 / 3, 1 / 3), (0.5, 0.5)
    m = [(x + y) / 2 for x, y in zip(p, q)]
    want = math.sqrt(
        sum(x * math.log(x / z) for x, z in zip(p, m)) / 2
        + sum(x * math.log(x / z) for x, z in zip(q, m)) / 2
    )
    assert got["half"].js_distance == pytest.approx(want)
    assert got["other"].cardinality_ratio == 1.0


def test_both_sides_empty(spark):
    nothing = column(spark, [None])
    row = utility.compare_distributions(nothing, {"n": nothing}, "v").first()
    assert row.cardinality_ratio == 0.0 and row.js_distance is None
