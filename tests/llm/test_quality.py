"""Quality rules: statistics against Python, held-out accuracy, edge rows."""

import math

import pytest
from pyspark.sql import functions as F

from veilframe.llm import quality
from veilframe.llm.queries import op9_quality_classifier


def test_statistics(spark):
    texts = ["Ab cd!! Ab\n\nx | y\nx | y", "", None, "# $ %", "w " * 50_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = [r._stats for r in quality.with_statistics(df).collect()]
    for text, got in zip(texts, rows, strict=True):
        text = text or ""
        words, lines = text.split(), [x for x in text.split("\n") if x]
        n = len(text)
        assert got.log_length == pytest.approx(math.log1p(n))
        assert got.capitals == pytest.approx(sum(c.isupper() for c in text) / n if n else 0)
        assert got.symbols == pytest.approx(sum(c in "#$%" for c in text) / n if n else 0)
        assert got.bangs == pytest.approx(text.count("!") / n if n else 0)
        assert got.per_word == pytest.approx(n / len(words) if words else 0)
        assert got.distinct_words == pytest.approx(len(set(words)) / len(words) if words else 0)
        assert got.distinct_lines == pytest.approx(len(set(lines)) / len(lines) if lines else 0)


def test_compiled_score_equals_the_rules(spark):
    rule = quality.Rule((("capitals", True, 0.2), ("log_length", False, 1.0)))
    model = quality.RuleEnsemble(-1.0, ((rule, 2.5),))
    docs = spark.createDataFrame(
        [(1, "abcdef"), (2, "ABCDEF"), (3, "a"), (4, None)], "doc_id bigint, text string"
    )
    got = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    yes, no = 1 / (1 + math.exp(-1.5)), 1 / (1 + math.exp(1.0))
    assert got == pytest.approx({1: yes, 2: no, 3: no, 4: no})
    assert quality.keep_good(docs, model).collect() == [docs.first()]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op9_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = got.where("held_out").collect()
    bad = [r for r in rows if r.quality == 0]
    good = [r for r in rows if r.quality == 1]
    assert sum(r.predicted == 0 for r in bad) >= 0.9 * len(bad)
    assert sum(r.predicted for r in good) >= 0.99 * len(good)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_edges_and_bound(spark):
    docs = spark.createDataFrame(
        [(i, ("good words here. " if i % 2 else "BAD!! ") * (1 + i % 5), i) for i in range(40)]
        + [(40, None, 0), (41, "", 0), (None, "x", 0), (1, "repeat", 0)],
        "doc_id bigint, text string, score int",
    )
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(40)] + [(40, None), (None, 1), (99, 1)], "doc_id bigint, quality int"
    )
    rows = quality.training_rows(docs, labels, "quality", F.lit(True), 10)
    assert 1 <= rows.count() <= 11
    model = quality.learn(docs, labels)
    out = quality.score_documents(docs, model)
    assert out.count() == docs.count() and out.columns == ["doc_id", "text", "score", "predicted"]
    assert all(0 <= r.score <= 1 for r in out.collect())
    only = quality.learn(docs, labels.where("quality = 1"))
    assert {r.predicted for r in quality.score_documents(docs, only).collect()} == {1}
    assert quality.score_documents(docs.limit(0), model).count() == 0
    assert quality.learn(docs.limit(0), labels).weights == ()
