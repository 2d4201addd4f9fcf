"""Toxicity: estimates against brute force, held-out accuracy, edge rows."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veilframe.llm import toxicity as tox
from veilframe.llm.queries import op2_toxicity


def test_heads_and_words():
    assert tox.heads("ab") == ["\x02a", "\x02ab", "\x02ab\x03"]
    assert tox.heads("abcd", 2) == ["\x02a", "\x02ab", "abc", "bcd", "cd\x03"]
    long = tox.heads("x" * 50)
    assert len(long) == 51 and {len(h) for h in long[7:]} == {tox.ORDER + 1}
    assert tox.words_of(" Ab!! ... ¡c? AB") == {"ab", "c"}
    assert tox.words_of(None) == tox.words_of("") == set()


def test_hashes_are_sparks(spark):
    texts = ["", "a", "\x02ab", "ñandú…", "x" * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h"))
    assert {r.t: r.h % 2**64 for r in rows.collect()} == {t: tox._hash(t) for t in texts}


TEXTS = [("the cat sat", 0), ("the dog the", 0), ("the idiot sat", 1), ("idiot cats", 1),
         ("idiots", 1), ("a b c the", 0), (None, 0), ("", 1), ("idiot", 1),
         ("unimaginable things", 0), ("unimaginably idiotic", 1)]


def counted(texts):
    count = [defaultdict(int), defaultdict(int)]
    for text, label in texts:
        for word in set(tox.words_of(text)):
            for head in tox.heads(word):
                count[label][head] += 1
    return count


def brute_model(texts):
    """(ratio of each spelling, backoff of each context, pooled counts), by the formulas."""
    count = counted(texts)
    all_heads = set(count[0]) | set(count[1])
    pooled = {h: count[0][h] + count[1][h] for h in all_heads}

    def discount(values):
        once, twice = (sum(v == n for v in values) for n in (1, 2))
        return max(0.1, once / (once + 2 * twice))

    taken = [discount(count[0].values()), discount(count[1].values())]
    shared_taken = discount(pooled.values())
    tails, befores = defaultdict(int), defaultdict(int)
    for h in all_heads:
        tails[h[-3:]] += 1
        befores[h[-3:][:-1]] += 1
    children = defaultdict(list)
    for h in all_heads:
        children[h[:-1]].append(h)
    ratios, backoffs = {}, {}
    for context, hs in children.items():
        def p(n, d, h, lower):
            total = sum(n[x] for x in hs)
            if not total:
                return lower
            return (max(n[h] - d, 0) + sum(min(n[x], d) for x in hs) * lower) / total

        for h in hs:
            shared = p(pooled, shared_taken, h, tails[h[-3:]] / befores[h[-3:][:-1]])
            one, nil = (p(count[c], taken[c], h, shared) for c in (1, 0))
            ratios[h] = math.log(one) - math.log(nil)
        left = []
        for c in (1, 0):
            total = sum(count[c][x] for x in hs)
            left.append(math.log(sum(min(count[c][x], taken[c]) for x in hs) / total) if total else 0.0)
        backoffs[context] = left[0] - left[1]
    return ratios, backoffs, pooled


def test_model_equals_brute_force(spark):
    df = spark.createDataFrame(TEXTS, "text string, label int").repartition(3)
    ratios, backoffs, pooled = brute_model(TEXTS)
    rows = tox.model(tox.head_counts(df)).collect()
    got = {r.context + c: v for r in rows for c, v in r.chars.items()}
    assert {h: v.ratio * 1e-9 for h, v in got.items()} == pytest.approx(ratios, abs=1e-8)
    assert {h: v.n for h, v in got.items()} == pooled
    assert {r.context: r.backoff * 1e-9 for r in rows} == pytest.approx(backoffs, abs=1e-8)
    assert all(0.1 <= d <= 1 for d in tox.discounts(tox.head_counts(df)).values())


def brute_word(word, fitted):
    ratios, backoffs, pooled = fitted
    value, support = 0.0, None
    for h in tox.heads(word):
        value += ratios[h] if h in ratios else backoffs.get(h[:-1], 0.0)
        support = pooled.get(h, 0) if support is None else min(support, pooled.get(h, 0))
    return value, support


@pytest.mark.parametrize("share", [0.0, 0.02, 2.0])  # all in place, some, all by the join
def test_word_ratios_wherever_they_are_looked_up(spark, share):
    docs = spark.createDataFrame(
        [("the idiot dogma the",), ("idiotic cab sat zzz",), ("unimaginable unimaginably unimaginatively",),
         ("the",), (None,), ("",), ("x" * 3000,)], "text string",
    )
    counts = tox.head_counts(spark.createDataFrame(TEXTS, "text string, label int"))
    spellings = tox.model(counts).cache()
    got = {r.entry: r for r in tox.word_ratios(tox.corpus_words(docs), spellings, hot_share=share).collect()}
    fitted = brute_model(TEXTS)
    assert got["the"].texts == 2 and set(got) == {w for r in docs.collect() for w in tox.words_of(r.text)}
    for word, row in got.items():
        value, support = brute_word(word, fitted)
        assert row.ratio * 1e-9 == pytest.approx(value, abs=1e-6) and row.support == support
    # Words that differ only after their seventh letter.
    assert abs(got["unimaginable"].ratio - got["unimaginably"].ratio) > 1e8


def test_calibration():
    found = tox.calibrated([(2, 3, 90, 10), (8, 5, 0, 40), (0, 1, 0, 0), (-4, 2, 500, 5)])
    assert found[8, 5] > found[2, 3] > found[-4, 2] and found[0, 1] == 0
    assert found[-4, 2] >= math.log(1 - tox.EXPRESSIONS)  # no word speaks against toxicity by much
    assert set(tox.calibrated([(1, 1, 0, 5), (2, 1, 0, 9)]).values()) == {0.0}


@pytest.mark.parametrize("share", [0.0, 0.2, 2.0])
def test_text_scores_wherever_words_are_looked_up(spark, share):
    docs = [(1, "a b b c"), (2, "a a a"), (2, "a a a"), (None, "d a"), (4, None), (5, ""), (6, "b, B! c")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    value = {"a": 3_000_000_000, "b": -5, "c": 0, "d": 7}
    texts = {"a": 5, "b": 2, "c": 2, "d": 1}
    values = spark.createDataFrame([(w, texts[w], v) for w, v in value.items()], "entry string, texts bigint, value bigint")
    wanted = []
    for i, t in docs:
        words = set(tox.words_of(t))
        wanted.append((i or 0, sum(value[w] for w in words) * 1e-9 / (len(words) + 50) if words else 0.0))
    got = sorted((r.doc_id or 0, r.ratio) for r in tox.with_ratio(df, values, hot_share=share).collect())
    assert [g[0] for g in got] == [w[0] for w in sorted(wanted)]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in sorted(wanted)], abs=1e-12)


def _scored(spark, make, n=400):
    """Mean scores of toxic and of ordinary texts, and of which the former reach 0.7."""
    rows = [(i, make(i, i % 4 == 0), int(i % 4 == 0)) for i in range(n)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = tox.score_toxicity(docs, labels, allowed=F.col("doc_id") % 3 != 1).where("doc_id % 3 = 1")
    out = {0: [], 1: []}
    for r in got.collect():
        out[int(r.doc_id % 4 == 0)].append(r.score)
    return out


def _prose(rng, n):
    return [rng.choice("bcdfghklmnprst") + rng.choice("aeiou") + rng.choice("lmnrst") + str(rng.randrange(9)) for _ in range(n)]


def test_many_mild_words_move_the_score(spark):
    """Twenty words, none telling, that toxic texts hold more often."""
    rng = random.Random(4)
    mild = [f"mild{c}{d}" for c in "abcde" for d in "wxyz"]

    def make(i, toxic):
        own = [w for w in mild if rng.random() < (0.5 if toxic else 0.08)]
        return " ".join(own + _prose(rng, 40))

    scores = _scored(spark, make)
    wrong = sum(s <= max(scores[0]) for s in scores[1])
    assert len(set(scores[1])) > 10 and wrong <= 0.1 * len(scores[1])


def test_words_that_differ_late(spark):
    """An insult whose first ten letters ordinary texts use as well."""
    rng = random.Random(6)
    endings = ["ness", "able", "ously", "ance"]

    def make(i, toxic):
        ending = "ologist" if toxic else rng.choice(endings)
        return " ".join(_prose(rng, 40) + ["despicably" + ending])

    scores = _scored(spark, make)
    assert min(scores[1]) > max(scores[0])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op2_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, "fine words", 0), (2, "awful idiot", 1), (2, "awful idiot", 1), (3, None, 0), (4, "", 0),
         (None, "no id", 0), (5, "long " * 100_000, 0), (6, "unlabelled", 0)],
        "doc_id bigint, text string, score int",
    )
    labels = spark.createDataFrame(
        [(1, 0, 0), (2, 1, 1), (3, 0, 0), (4, None, 1), (9, 1, 1), (None, 1, 1)],
        "doc_id bigint, toxic int, text int",
    )
    out = tox.score_toxicity(docs, labels)
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 2, 2, 3, 4, 5, 6]
    assert all(0 <= r.score <= 1 for r in out.collect())
    none = tox.score_toxicity(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert tox.score_toxicity(docs.limit(0), labels).count() == 0
    nobody = tox.score_toxicity(docs, labels, allowed=F.lit(False)).collect()
    assert {r.score for r in nobody} == {0.5}
