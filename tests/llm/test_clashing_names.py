"""Extra columns called like the operators' own helpers pass through unharmed."""

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from veilframe.llm import mixing, neardup, quality, secrets

CLASHES = (
    "_row", "_copy", "_use", "_uses", "_start", "_use_row", "_use_id", "_words", "_lines", "_stats",
    "_stat_bars", "_score", "score", "predicted", "_blob", "_hit", "_hit_blob", "findings", "_kept",
    "_nth", "doc", "label", "size", "row", "start", "key", "node", "content", "kept", "class_id",
    "bucket", "block", "epoch", "slot", "target", "source_no", "features", "_id",
)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"word{i % 7} token=abcdef{i % 3} and more words here {i}", "en", f"s{i % 3}", 40)
            for i in range(40)]
    df = spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"
    )
    return df.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id")) for c in CLASHES})


def kept_as_they_were(df):
    wrong = F.lit(False)
    for c in CLASHES:
        wrong = wrong | ~F.col(f"`{c}`").eqNullSafe(F.concat(F.lit(f"{c}:"), F.col("doc_id")))
    return df.where(wrong).count() == 0


def test_stages(spark, docs):
    model = quality.RuleEnsemble(1.0, ())
    for out in (
        quality.keep_good(docs, model),
        neardup.keep_one_each(docs),
        secrets.redact_documents(docs),
        mixing.mixed_documents(docs),
    ):
        assert out.columns == docs.columns and out.count() > 0
        assert kept_as_they_were(out)
    assert secrets.redact_documents(docs).where("text like '%token=%'").count() == 0
    assert pipeline.pack(spark, docs, "").count() > 0


def test_scores(docs):
    scored = quality.score_documents(docs, quality.RuleEnsemble(1.0, ()))
    assert scored.columns == [c for c in docs.columns if c not in ("score", "predicted")] + ["score", "predicted"]
    assert scored.where("predicted = 1").count() == 40
