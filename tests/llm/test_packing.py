"""Packing: exact cover of every document, full windows, edge rows."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from veilframe.llm.packing import balanced, differenced, encoder, pack_documents

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def check(rows, texts, capacity):
    """`texts`: (doc_id, text) list without repeated ids."""
    full = Tokenizer.from_file(JSON)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {d for d, _ in texts}
    for doc, text in texts:
        ids = np.array([*full.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for members in by_seq.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return {s: sum(r.length for r in m) for s, m in by_seq.items()}


def test_documents_are_covered_and_windows_full(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    lengths = check(pack_documents(docs, JSON, RANKS).collect(), texts, 2048)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths.values())
    assert padding < 0.02 * sum(lengths.values())


def test_edges(spark):
    texts = [
        (1, None), (2, ""), (3, "a <|endoftext|> b"), (4, "word " * 3000), (5, "ä" * 40), (None, "x"),
    ]
    docs = spark.createDataFrame(
        [(d, t, 9) for d, t in texts], "doc_id bigint, text string, offset int"
    ).coalesce(1)
    for ranks in (None, RANKS):
        rows = pack_documents(docs, JSON, ranks, capacity=64, windows=4, piece=16, slack=1).collect()
        check(rows, texts, 64)
    empty = pack_documents(docs.limit(0), JSON, RANKS)
    assert empty.count() == 0 and "sequence_id" in empty.columns
    twice = pack_documents(docs.where("doc_id = 4").union(docs.where("doc_id = 4")), JSON, RANKS)
    assert twice.selectExpr("sum(length)").first()[0] == 2 * twice.first().doc_tokens
    kept = pack_documents(docs, JSON, RANKS, keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in kept)
    with pytest.raises(ValueError):
        pack_documents(docs, JSON, capacity=0)


def test_both_encoders_agree():
    fast, slow = encoder(JSON, RANKS), encoder(JSON, None)
    for text in ("", " a  b\n\nc", "¡ünï!", "x" * 500, "<|endoftext|>", " ퟿ 0123456789"):
        assert fast(text) == slow(text)


def test_differencing():
    rng = np.random.default_rng(3)
    for bins in (1, 2, 7):
        sizes = rng.integers(1, 100, 60)
        members = differenced(sizes, bins)
        assert sorted(i for m in members for i in m) == list(range(60))
        sums = [int(sizes[m].sum()) for m in members]
        assert max(sums) - min(sums) <= 20
    # 3 + 3 + 3 does not fit two bins of 5, so the count rises to three.
    assert sorted(map(len, balanced(np.array([3, 3, 3]), 5, 2))) == [1, 1, 1]


def test_tails_of_many_splits_are_packed_together(spark):
    """211 splits with a tail each: short sequences are as few as the second pass has tasks."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = pack_documents(docs.repartition(211, "doc_id"), JSON, RANKS).collect()
    lengths = check(rows, texts, 2048)
    tokens = sum(lengths.values())
    assert sum(n < 1024 for n in lengths.values()) <= 22
    assert len(lengths) <= 1.02 * -(-tokens // 2048) + 22
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths.values())
    assert padding < 0.01 * tokens
    # Layout and retries: the same splits give the same windows.
    again = pack_documents(docs.repartition(211, "doc_id"), JSON, RANKS).collect()
    assert len(again) == len(rows) and len({r.sequence_id for r in again}) == len(lengths)
