"""Benchmark windows in documents, against a scan word by word."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.llm import decontamination as dec
from veilframe.llm.words import places, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, items string"


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    """(id, words, hit words, item ids) of each document."""
    out = []
    for ident, text in docs:
        own, hit, found = split(text), set(), set()
        for item, given in items:
            other = split(given)
            length = min(size, len(other))
            grams = {tuple(other[i : i + length]) for i in range(len(other) - length + 1)} if length else set()
            for i in range(len(own) - length + 1):
                if grams and tuple(own[i : i + length]) in grams:
                    hit.update(range(i, i + length))
                    if item is not None:
                        found.add(str(item))
        out.append((ident, len(own), len(hit), sorted(found)))
    return sorted(out, key=repr)


def made(seed=3):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "ñandú", "o'clock", "x1", "été"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 9, 10, 11, 30])))) for i in range(40)]
    items = [(i, t) for i, t in items if len(split(t)) > 2]
    items += [(100, "one-of.a KIND"), (100, "another of this id " * 4), (None, "no id here " * 5), (101, ""), (102, None)]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(items)[1] or "", "..!", rng.choice(vocabulary)]
        docs.append((i, " ".join(parts)))
    docs += [(7, docs[7][1]), (None, "ONE (of) a: kind"), (200, None), (201, ""), (202, "?!"), (203, "word " * 20_000 + "one of a kind")]
    return docs, items


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = made()
    return (
        spark.createDataFrame([(*d, "as it was") for d in docs], SCHEMA),
        spark.createDataFrame(items, "item_id bigint, text string"),
        docs, items,
    )


@pytest.mark.parametrize("slice_bytes", [dec.SLICE_BYTES, 4000])
def test_equals_brute_force(tables, slice_bytes):
    docs, benchmark, given, items = tables
    if slice_bytes < dec.SLICE_BYTES:
        assert len(dec.sliced(dec.benchmark_windows(benchmark), slice_bytes)) > 2
    found = dec.contamination(docs, benchmark, slice_bytes=slice_bytes)
    assert found.columns == ["doc_id", "n_words", "n_hit", "items"]
    assert sorted(((r[0], r[1], r[2], list(r[3])) for r in found.collect()), key=repr) == brute(given, items)


@pytest.mark.parametrize("slice_bytes", [dec.SLICE_BYTES, 4000])
def test_removal(tables, slice_bytes):
    docs, benchmark, given, items = tables
    expected = {repr(r[0]): r for r in brute(given, items)}
    kept = dec.remove_documents(docs, benchmark, slice_bytes=slice_bytes)
    assert kept.columns == docs.columns and kept.where("items <> 'as it was'").count() == 0
    assert sorted(repr(r[0]) for r in kept.collect()) == sorted(k for k, r in expected.items() if r[2] == 0)
    cut = dec.remove_spans(docs, benchmark, slice_bytes=slice_bytes)
    assert cut.schema == docs.schema and cut.count() == docs.count()
    texts = {repr(i): t for i, t in given}
    for row in cut.collect():
        _, n, hit, _ = expected[repr(row.doc_id)]
        assert len(split(row.text)) == n - hit
        if hit == 0:
            assert row.text == texts[repr(row.doc_id)]
    half = dec.remove_documents(docs, benchmark, max_share=0.5)
    assert half.count() == sum(
        2 * expected[repr(i)][2] <= expected[repr(i)][1] for i, _ in given
    )


def test_cut_leaves_the_rest(spark):
    docs = spark.createDataFrame([(1, "Bö: one, two THREE! end")], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    assert dec.remove_spans(docs, benchmark).first().text == "Bö: ! end"


def test_empty_tables(spark, tables):
    docs, benchmark, given, _ = tables
    nothing = dec.contamination(docs, benchmark.limit(0))
    assert nothing.count() == len(given) and nothing.where("n_hit > 0 or size(items) > 0").count() == 0
    assert dec.contamination(docs.limit(0), benchmark).count() == 0
    assert dec.remove_spans(docs.limit(0), benchmark).columns == docs.columns


def test_hashes_never_decide_alone(spark, monkeypatch):
    """With hashes that all collide the words still do."""
    docs, items = made(5)
    table = dec.as_table(
        dec.benchmark_windows(spark.createDataFrame(items, "item_id bigint, text string")).toArrow()
    )
    one = {"hashes": table.hashes * 0, "seen": table.seen | True}
    collided = dec.Windows(**{**table.__dict__, **one})
    real = dec.window_hashes
    monkeypatch.setattr(dec, "window_hashes", lambda w, ls: {k: v * 0 for k, v in real(w, ls).items()})
    for _, text in docs[:30]:
        own = words((text or "").encode())
        monkeypatch.setattr(dec, "window_hashes", real)
        expected = table.hits(own)
        monkeypatch.setattr(dec, "window_hashes", lambda w, ls: {k: v * 0 for k, v in real(w, ls).items()})
        assert collided.hits(own) == expected


def test_words_are_the_contracts(spark):
    text = "".join(map(chr, range(1, 0x250))) + " Ünïcode 漢字 x y\u0085z"
    raw = text.encode()
    assert [w.decode() for w in words(raw)] == split(text)
    assert [raw[a:b].lower() for a, b in places(raw)] == words(raw)
    assert words(None) == words(b"") == []


def test_clashing_names(spark):
    names = ["_row", "_of", "_items", "_ranges", "_n_hit", "_own_text", "window", "hash"]
    docs = spark.createDataFrame([(1, "one two three")], "doc_id bigint, text string")
    docs = docs.withColumns({n: F.lit(n) for n in names})
    benchmark = spark.createDataFrame(
        [(1, "one two three", "x"), (2, "four five six", "y")], "item_id bigint, text string, hash string"
    )
    for bound in (dec.SLICE_BYTES, 60):
        cut = dec.remove_spans(docs, benchmark, slice_bytes=bound)
        assert cut.collect() == [(1, "", *names)]
        assert dec.remove_documents(docs, benchmark, slice_bytes=bound).count() == 0
