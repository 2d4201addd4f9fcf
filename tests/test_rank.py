"""Positions, samples, shuffles, hot keys, medians."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from veilframe.operators.lookup import lookup_join
from veilframe.operators.median import exact_median
from veilframe.operators.rank import bucket_starts, dense_ids, exact_sample, keyed_rank
from veilframe.operators.shuffle import shuffle_columns
from veilframe.operators.surrogate import apply_mapping, clashes, extend_mapping
from veilframe.operators.surrogate_store import open_store


def test_keyed_rank_is_a_permutation_whatever_the_bucket_size(spark):
    df = spark.range(1000)
    orders = []
    for rows in (7, 100, 10_000):
        got = keyed_rank(df, "id", "k", "l", rows_per_bucket=rows).collect()
        assert sorted(r["rank"] for r in got) == list(range(1, 1001))
        orders.append({r["id"]: r["rank"] for r in got})
    assert orders[0] == orders[1] == orders[2]


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_bucket_starts_over_several_blocks(spark, levels):
    step = 300_011
    counts = spark.range(-20_000_000, 50_000_000, step).select(
        F.col("id").alias("b"), (F.pmod("id", F.lit(5)) + 1).alias("n")
    )
    got = {r["b"]: r["before"] for r in bucket_starts(counts, "b", "n", levels).collect()}
    total = 0
    for b in range(-20_000_000, 50_000_000, step):
        assert got[b] == total
        total += b % 5 + 1


def test_dense_ids_keep_order_and_close_gaps(spark):
    keys = [-(2**62), -250, -3, 0, 7, 8, 99, 100, 101, 5000, 2**62]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = dense_ids(df, "k", rows_per_bucket=10).collect()
    assert {r["k"]: r["id"] for r in got} == {k: i + 1 for i, k in enumerate(keys)}


@pytest.mark.parametrize("rows", [0, 1, 37, 999, 1000, 1500])
def test_exact_sample_is_the_start_of_the_keyed_order(spark, rows):
    df = spark.range(1000)
    a = {r.id for r in exact_sample(df, "id", rows, "k", total_rows=1000).collect()}
    b = {r.id for r in exact_sample(df, "id", rows, "k").collect()}
    assert a == b and len(a) == min(rows, 1000)
    ranked = keyed_rank(df, "id", "k", "sample").where(F.col("rank") <= rows)
    assert {r.id for r in ranked.collect()} == a


def test_sample_with_repeated_identifiers_fails_loudly(spark):
    same = spark.range(1000).select(F.lit(7).alias("id"))
    with pytest.raises(Exception, match="unique"):
        exact_sample(same, "id", 100, "k").collect()


def test_sample_of_nothing(spark):
    assert exact_sample(spark.range(0), "id", 5, "k").count() == 0


def test_shuffle_keeps_the_values_and_moves_them(spark):
    df = spark.range(2000).select(
        "id", (F.col("id") % 50).alias("a"), F.concat(F.lit("v"), F.col("id")).alias("b")
    )
    got = shuffle_columns(df, ["a", "b"], rows_per_bucket=300).orderBy("id").collect()
    before = df.orderBy("id").collect()
    assert [r.id for r in got] == [r.id for r in before]
    for c in ("a", "b"):
        assert sorted(r[c] for r in got) == sorted(r[c] for r in before)
    assert sum(g.b != o.b for g, o in zip(got, before)) > 1900
    # The two columns do not travel together.
    assert sum(g.a == int(g.b[1:]) % 50 for g in got) < 200


@pytest.mark.parametrize("hot_keys", [3, None])
def test_lookup_with_hot_and_null_keys(spark, hot_keys):
    rows = [("hot", i) for i in range(500)] + [(None, i) for i in range(300)]
    rows += [(f"k{i % 100}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int")
    table = df.where("k is not null and k <> 'k7'").groupBy("k").agg(F.count("*").alias("n"))
    table = table.withColumn("p", F.upper("k"))
    found = lookup_join(df, table, ["k"], "p", "n", hot_keys)
    got = sorted((r.k or "", r.i, r.p) for r in found.collect())
    want = sorted(
        (k or "", i, None if k in (None, "k7") else k.upper()) for k, i in rows
    )
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, w)) for w in want]


def test_surrogates_are_stable_per_column_and_value(spark):
    df = spark.createDataFrame(
        [(1, "x", "x"), (2, "y", "x"), (3, None, "z")], "id int, a string, b string"
    )
    first = extend_mapping(df, ["a"], key="one")
    both = extend_mapping(df, ["a", "b"], first, key="two")
    old = {(r.column_name, r.original_value): r.surrogate_value for r in first.collect()}
    new = {(r.column_name, r.original_value): r.surrogate_value for r in both.collect()}
    assert set(new) == {("a", "x"), ("a", "y"), ("b", "x"), ("b", "z")}
    assert all(new[k] == v for k, v in old.items())
    assert new[("a", "x")] != new[("b", "x")]
    assert all(len(v) == 20 and v.startswith("SRG-") for v in new.values())
    assert clashes(both).count() == 0
    got = {r.id: (r.a, r.b) for r in apply_mapping(df, ["a", "b"], both).collect()}
    assert got[3] == (None, new[("b", "z")])
    assert got[1] == (new[("a", "x")], new[("b", "x")])
    # Nothing new: the mapping stays as it is.
    again = extend_mapping(df, ["a", "b"], both, key="three")
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in both.collect()}


def _mapped(store):
    return {(r.column_name, r.original_value): r.surrogate_value for r in store.mapping().collect()}


def test_a_store_keeps_its_surrogates(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "x", 5), (2, "y", 6), (3, None, 5), (4, "", None)], "id int, a string, b int"
    )
    path = str(tmp_path / "store")
    assert open_store(spark, path, buckets=4).add(df.where("id < 3"), ["a"], key="one") == 2
    first = _mapped(open_store(spark, path))
    store = open_store(spark, path, buckets=99)  # the number of buckets is the store's own
    assert store.buckets == 4
    assert store.add(df, ["a", "b"], key="two") == 3
    assert store.add(df, ["a", "b"], key="three") == 0
    both = _mapped(store)
    assert set(both) == {("a", "x"), ("a", "y"), ("a", ""), ("b", "5"), ("b", "6")}
    assert first == {k: both[k] for k in first} and clashes(store.mapping()).count() == 0
    # A session that knows nothing of the store finds it by its folder.
    for part in ("values", "taken"):
        spark.sql(f"DROP TABLE {store._table(part)}")
    found = open_store(spark, path)
    assert found.buckets == 4 and _mapped(found) == both and found.add(df, ["a", "b"], key="four") == 0
    # The same values as a mapping kept in one table gives.
    plain = extend_mapping(df, ["a", "b"], extend_mapping(df.where("id < 3"), ["a"], key="one"), key="two")
    assert {(r.column_name, r.original_value): r.surrogate_value for r in plain.collect()} == both
    for hot_keys in (None, 1):
        got = {r.id: (r.a, r.b) for r in store.apply(df, ["a", "b"], hot_keys).collect()}
        assert got[1] == (both["a", "x"], both["b", "5"]) and got[3] == (None, both["b", "5"])
        assert got[4] == (both["a", ""], None)


def test_a_store_passes_over_taken_surrogates(spark, tmp_path, monkeypatch):
    """Digests cut to one of two: most values wait for a later round."""
    from veilframe.operators import surrogate_store

    real = surrogate_store._surrogate
    monkeypatch.setattr(
        surrogate_store, "_surrogate", lambda text, key: F.concat(F.substring(real(text, key), 1, 5))
    )
    df = spark.createDataFrame([(f"v{i}",) for i in range(9)], "a string")
    store = open_store(spark, str(tmp_path / "store"), buckets=2)
    assert store.add(df.limit(4), ["a"], key="k") == 4
    before = _mapped(store)
    assert store.add(df, ["a"], key="k") == 5
    after = _mapped(store)
    assert len(after) == 9 and len(set(after.values())) == 9
    assert before == {k: after[k] for k in before}


@pytest.mark.parametrize("stop_at", [1, 2])
def test_a_run_that_fails_midway_is_made_up_for(spark, tmp_path, monkeypatch, stop_at):
    from veilframe.operators.surrogate_store import SurrogateStore

    df = spark.createDataFrame([(f"v{i}",) for i in range(40)], "a string")
    whole = open_store(spark, str(tmp_path / "whole"), buckets=2)
    whole.add(df, ["a"], key="k")
    store = open_store(spark, str(tmp_path / "store"), buckets=2)
    real, calls = SurrogateStore._append, []

    def stop(self, rows, part):
        calls.append(part)
        if len(calls) == stop_at:
            real(self, rows.where("hash(original_value) % 2 = 0"), part)  # only part arrives
            raise OSError("lost")
        real(self, rows, part)

    monkeypatch.setattr(SurrogateStore, "_append", stop)
    with pytest.raises(OSError):
        store.add(df, ["a"], key="k")
    monkeypatch.setattr(SurrogateStore, "_append", real)
    store.add(df, ["a"], key="k")
    assert _mapped(store) == _mapped(whole) and store._taken().count() == 40


def test_a_compacted_store_answers_as_before(spark, tmp_path):
    path = str(tmp_path / "store")
    store = open_store(spark, path, buckets=2)
    for n in range(4):
        df = spark.createDataFrame([(f"v{i}",) for i in range(n * 10, n * 10 + 15)], "a string")
        store.add(df, ["a"], key=f"k{n}")
    before, files_before = _mapped(store), len(store.mapping().inputFiles())
    store.compact()
    assert _mapped(store) == before and len(before) == 45
    assert len(store.mapping().inputFiles()) == 2 < files_before
    assert store.add(df, ["a"], key="other") == 0 and store._taken().count() == 45
    assert store.add(spark.createDataFrame([("new",)], "a string"), ["a"], key="k") == 1
    assert len(_mapped(open_store(spark, path))) == 46
    assert {p.name for p in (tmp_path / "store").iterdir() if not p.name.endswith(".crc")} == {"layout", "values", "taken"}


def test_values_the_mapping_lacks_become_null(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, 4)], "a string, _row int")
    mapping = extend_mapping(df.where("a = 'y'"), ["a"], key="k")
    for hot_keys in (None, 1):
        got = {r["_row"]: r.a for r in apply_mapping(df, ["a"], mapping, hot_keys).collect()}
        assert got[1] is got[2] is got[4] is None and got[3].startswith("SRG-")


def test_a_clash_is_resolved(spark):
    df = spark.createDataFrame([("x",)], "a string")
    taken = extend_mapping(df, ["a"], key="k").select(
        F.lit("a").alias("column_name"), F.lit("other").alias("original_value"), "surrogate_value"
    )
    both = extend_mapping(df, ["a"], taken, key="k")
    assert both.count() == 2 and clashes(both).count() == 0
    assert taken.first()["surrogate_value"] in {r.surrogate_value for r in both.collect()}


@pytest.mark.parametrize("per_unit", [1, 1024])
def test_exact_median(spark, per_unit):
    rng = random.Random(5)
    groups = {
        "one": [3.5],
        "two": [1.0, 2.0],
        "tail": [rng.lognormvariate(0, 3) for _ in range(501)],
        "mixed": [rng.uniform(-100, 100) for _ in range(400)],
        "same": [7.0] * 300,
        "halves": [-5.0] * 10 + [5.0] * 10,
        None: [0.0, 1.0, 10.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("one", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r["median"] for r in exact_median(
        df, ["g"], "v", ranges_per_unit=per_unit, ordered_values=7).collect()}
    assert got == {g: statistics.median(v) for g, v in groups.items()}


@pytest.mark.parametrize("cut", [0, 1000])
def test_exact_median_orders_nan_last(spark, cut):
    nan, inf = float("nan"), float("inf")
    groups = {"a": [1.0, 2.0, nan], "b": [1.0, nan, nan], "c": [-inf, 0.0, 3.0, inf], "d": [nan],
              "e": [inf, inf, 1.0], "f": [1e308, -1e308, 5.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r.g: r["median"] for r in exact_median(df, ["g"], "v", ordered_values=cut).collect()}
    want = {r.g: r["m"] for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert repr(sorted(got.items())) == repr(sorted(want.items()))


def test_median_ranges_of_a_narrow_band_stay_small(spark):
    from veilframe.operators import median

    seconds = spark.range(200_000).select((F.col("id") + 1_700_000_000).cast("double").alias("v"))
    sizes = []
    original = median.middle_range

    def watched(values, keys):
        out = original(values, keys)
        sizes.append(out.count())
        return out

    median.middle_range = watched
    try:
        got = exact_median(seconds, [], "v", ordered_values=500).first()["median"]
    finally:
        median.middle_range = original
    assert got == 1_700_000_000 + 99_999.5
    assert sizes[-1] <= 200
