"""The pipeline's stages on a given table: columns, decisions, and what each must keep."""

import hashlib
import re

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_neardup import nd
from test_secrets import expected

from veilframe.llm.common import stored_once

SF_DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = [docs]
    for name, stage in pipeline.STAGES[:-1]:
        out = stored_once(stage(spark, kept[-1], SF_DIR), "test-stage")
        assert (name, out.columns) == (name, docs.columns)
        assert out.dtypes == docs.dtypes
        kept.append(out)
    given, good, single, clean, mixed = kept
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    share = good.join(labels, "doc_id").groupBy("quality").count().collect()
    counts = {r.quality: r["count"] for r in share}
    whole = {r.quality: r["count"] for r in given.join(labels, "doc_id").groupBy("quality").count().collect()}
    assert counts.get(0, 0) < 0.2 * whole[0] and counts[1] > 0.98 * whole[1]

    ids = [r.doc_id for r in single.collect()]
    classes = {r.doc_id: r.class_id for r in nd.near_duplicates(good).collect()}
    assert sorted(ids) == sorted(set(classes.values())) and len(ids) < good.count()

    before = {r.doc_id: r.text for r in single.collect()}
    after = {r.doc_id: r for r in clean.collect()}
    assert set(after) == set(before)
    nothing = expected("")
    for doc, text in before.items():
        if expected(text) == nothing:
            assert "[SECRET]" in (after[doc].text or "") or after[doc].text == text
        else:
            assert expected(after[doc].text)[3] == hashlib.sha256(b"").hexdigest()
            assert after[doc].n_chars == len(after[doc].text)

    sizes = {d: len(WORD.findall(r.text or "")) for d, r in after.items()}
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert all(n <= 3 * sizes[d] for d, n in taken.items())
    assert abs(sum(taken.values()) - sum(sizes.values())) <= 25

    packed = pipeline.STAGES[-1][1](spark, mixed, SF_DIR)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run_and_empty(spark):
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stored_once(stage(spark, docs, SF_DIR), "test-stage")
        assert docs.count() == 0
