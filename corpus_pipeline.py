"""From raw documents to packed training sequences, stage by stage.

Each stage is a function of (spark, docs, sf_dir) over all documents its predecessor kept.
All but the last return the columns of `documents`; their results are written and reread.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import mixing, neardup, packing, quality, secrets
from veilframe.llm.common import held_out, stored_once, table


def drop_poor_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rule ensemble does not reject; labels of the held-out fold are not learnt."""
    ensemble = quality.learn(
        docs, table(spark, sf_dir, "labels"), allowed=~held_out("doc_id", 5, 0)
    )
    return quality.keep_good(docs, ensemble)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id."""
    del spark, sf_dir
    return neardup.keep_one_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    del spark, sf_dir
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix takes."""
    del spark, sf_dir
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    del spark, sf_dir
    return packing.pack_documents(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )


STAGES = [
    ("quality classifier", drop_poor_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

# A forest, minimum hashes and a tokenizer cannot be written in SQL; tests compare the
# stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored_once(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
