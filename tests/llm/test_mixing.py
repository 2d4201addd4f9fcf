"""Mixing against a brute-force plan: targets, whole accounting, permutation, text parts."""

import re

import pytest
from pyspark.sql import functions as F

from veilframe.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, cap=3):
    """Iterated sharing by weights 1, 2, 3."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(cap * sizes[s]) for s in over}


def run(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, slot int")
    placed, pieces = mixing.mix_plan(docs, **settings)
    return docs, mixing.taken_words(placed, pieces).collect(), pieces


def test_targets_and_accounting(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), "ab"[i % 7 == 0], 0) for i in range(200)]
    rows += [(900, "x y z", "tiny", 0), (901, "x y z", "tiny", 0), (902, None, None, 0),
             (903, "  ", None, 0), (904, "long " * 3000, "é", 0), (904, "long " * 3000, "é", 0),
             (None, "no id", "b", 0)]
    docs, got, pieces = run(spark, rows, block_words=32, bucket_rows=16)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = targets(sizes)
    assert len(got) == len(rows)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    by_id = {d: s for d, _, s, _ in rows}
    taken = {}
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, n in taken.items():
        assert n == pytest.approx(want[s], abs=1.001)
    # Every word of a source is taken floor or ceil of target/size times, by distinct slots.
    assert pieces.where("hi <= lo or lo < 0").count() == 0
    assert pieces.groupBy("slot", "source_no").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).where(
        "n > 32").count() == 0


def test_reruns_and_layouts_agree(spark):
    rows = [(i, "w " * (i % 40), f"s{i % 5}", 0) for i in range(300)]
    _, a, _ = run(spark, rows)
    docs = spark.createDataFrame(rows[::-1], "doc_id bigint, text string, source string, slot int")
    placed, pieces = mixing.mix_plan(docs.repartition(7))
    b = mixing.taken_words(placed, pieces).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_permutation_is_a_bijection_with_inverse(spark):
    for n in (1, 2, 5, 64, 1000):
        df = spark.range(n).withColumn("p", mixing.permuted(F.col("id"), F.lit(n), F.lit(7)))
        df = df.withColumn("back", mixing.permuted(F.col("p"), F.lit(n), F.lit(7), inverse=True))
        rows = df.collect()
        assert sorted(r.p for r in rows) == list(range(n))
        assert all(r.back == r.id for r in rows)
        if n == 1000:
            assert sum(r.p == r.id for r in rows) < 20


def test_mixed_documents_take_the_planned_words(spark):
    rows = [(i, f" a{i}\n" + "w\t" * (i % 90), f"s{i % 4}", 0) for i in range(120)]
    rows += [(5, "same  text here", "s1", 0)] * 3 + [(6, None, None, 0), (7, "", "s1", 0)]
    docs, got, _ = run(spark, rows, block_words=16)
    mixed = mixing.mixed_documents(docs, block_words=16)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    planned = {}
    for r in got:
        planned[r.doc_id] = planned.get(r.doc_id, 0) + r.taken
    assert words == {d: n for d, n in planned.items() if n}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string, n_chars bigint")
    placed, pieces = mixing.mix_plan(docs)
    assert mixing.taken_words(placed, pieces).count() == 0
    assert mixing.mixed_documents(docs).count() == 0


def test_counts_per_shard_are_multinomial(spark):
    """Draws of three sources with shares 1/6, 2/6, 3/6 in shards of 120 slots."""
    sequences = spark.createDataFrame([(0, 4_000), (1, 8_000), (2, 12_000)], "source_no int, slots bigint")
    drawn = mixing.drawn_slots(sequences, 120, seed=5).cache()
    assert drawn.count() == 24_000
    # Every slot of every sequence once, every place of every shard once.
    for no, n in ((0, 4_000), (1, 8_000), (2, 12_000)):
        slots = [r.slot for r in drawn.where(F.col("source_no") == no).select("slot").collect()]
        assert sorted(slots) == list(range(n))
    assert drawn.select("shard", "place").distinct().count() == 24_000
    per = drawn.groupBy("shard").pivot("source_no", [0, 1, 2]).count().na.fill(0).collect()
    assert len(per) == 200 and all(r["0"] + r["1"] + r["2"] == 120 for r in per)
    # Mean and variance of a multinomial: n p and n p (1 - p); the last shards are corrected.
    for no, p in ((0, 1 / 6), (1, 2 / 6), (2, 3 / 6)):
        counts = [r[str(no)] for r in per if r.shard < 190]
        mean = sum(counts) / len(counts)
        variance = sum((c - mean) ** 2 for c in counts) / len(counts)
        assert mean == pytest.approx(120 * p, abs=1.5)
        assert 0.7 < variance / (120 * p * (1 - p)) < 1.4
    # A source's slots rise with the shards, but for the corrected end.
    early = drawn.where("shard < 150").groupBy("source_no", "shard").agg(
        F.min("slot").alias("a"), F.max("slot").alias("b")).orderBy("source_no", "shard").collect()
    for x, y in zip(early, early[1:]):
        assert x.source_no != y.source_no or x.b + 1 == y.a
    again = mixing.drawn_slots(sequences.repartition(3), 120, seed=5)
    assert drawn.exceptAll(again).count() == 0
    other = mixing.drawn_slots(sequences, 120, seed=6)
    assert drawn.exceptAll(other).count() > 10_000


def test_draws_are_numbered_once_and_written(spark):
    sequences = spark.createDataFrame([(0, 700), (1, 300)], "source_no int, slots bigint")
    drawn = mixing.drawn_slots(sequences, 120, seed=5)
    text = drawn._jdf.queryExecution().executedPlan().toString()
    # Left are the running sums of what sources have too many and too few of.
    assert "row_number" not in text and len(re.findall(r"Window \[", text)) == 2
    assert {r[0]: r[1] for r in drawn.groupBy("source_no").count().collect()} == {0: 700, 1: 300}


def test_sequences_are_as_long_as_their_words(spark):
    """Slots counted in advance are those that take words, whatever the target's remainder."""
    for rest in (0, 1, 15, 16, 17, 40, 150, 163, 164):
        target = spark.createDataFrame(
            [(0, 164, 11, 1, rest, 4), (1, 176, 11, 0, rest, 16)],
            "source_no int, source_size bigint, blocks bigint, epochs bigint, rest bigint, last_block bigint",
        )
        for seed in range(4):
            for row in mixing._with_slots(target, 16, seed).join(target, "source_no").collect():
                one = target.where(F.col("source_no") == row.source_no)
                key = F.xxhash64(F.lit(seed), "source_no", F.col("epochs").alias("epoch"))
                order = one.select(F.posexplode(F.transform(
                    F.sequence(F.lit(0), F.lit(10)), lambda i: mixing.permuted(i, F.lit(11), key)))).collect()
                left, used = rest, 0
                for _, block in sorted(order):
                    if left <= 0:
                        break
                    left -= row.last_block if block == 10 else 16
                    used += 1
                assert row.slots == row.epochs * 11 + used


def test_the_mixed_corpus_comes_by_shards(spark):
    rows = [(i, f"t{i} " + "w " * (20 + i % 50), f"s{i % 3}", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, first int")
    mixed = mixing.mixed_documents(docs, shard="shard", block_words=16, shard_slots=128)
    assert mixed.columns == [*docs.columns, "shard"]
    got = mixed.withColumn("part", F.spark_partition_id()).collect()
    assert len({(r.shard, r.part) for r in got}) == len({r.shard for r in got}) > 5
    placed, pieces = mixing.mix_plan(docs, block_words=16, shard_slots=128)
    first = {}
    for r in pieces.collect():
        key = (r.doc_id, r.epoch)
        first[key] = min(first.get(key, (r.shard, r.place, r.lo)), (r.shard, r.place, r.lo))
    assert sorted((r.doc_id, r.shard) for r in got) == sorted((d, f[0]) for (d, _), f in first.items())
    order = {}
    for r in got:
        order.setdefault(r.shard, []).append(r.doc_id)
    for shard, ids in order.items():
        assert ids == [d for (d, _), f in sorted(first.items(), key=lambda x: (x[1], x[0][0])) if f[0] == shard]
    sizes = pieces.groupBy("shard").agg(F.countDistinct("place").alias("n")).collect()
    assert sorted(r.n for r in sizes)[1:] == [128] * (len(sizes) - 1)  # all but the last are full
