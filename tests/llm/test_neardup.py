"""Near duplicates against brute force, alignment against dynamic programming, edge rows."""

import random

import numpy as np
import pytest

from veilframe.llm import neardup as nd
from veilframe.llm.components import components
from veilframe.llm.queries import op7_minhash_neardup


def table_lcs(a, b, band):
    best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(len(a)):
        for j in range(len(b)):
            hit = best[i, j] + 1 if a[i] == b[j] and abs(i - j) <= band else 0
            best[i + 1, j + 1] = max(hit, best[i, j + 1], best[i + 1, j])
    return int(best[-1, -1])


def test_alignment_equals_dynamic_programming():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint32)
        b = rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint32)
        band = int(rng.integers(0, 25))
        # Ends are matched off first, so the band is counted from there.
        head = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        x, y = a[head:], b[head:]
        n = min(len(x), len(y))
        tail = next((i for i in range(n) if x[-1 - i] != y[-1 - i]), n)
        want = head + tail + table_lcs(x[: len(x) - tail], y[: len(y) - tail], band)
        assert nd.aligned_matches(a, b, band) == want


def similar(a, b, k=nd.K):
    x, y = nd.kmers(nd.words_of(a), k), nd.kmers(nd.words_of(b), k)
    if not len(x) or not len(y):
        return len(x) == len(y)
    m = table_lcs(x, y, max(len(x), len(y)))
    return m / (len(x) + len(y) - m) >= nd.SIMILARITY - 1e-9


def brute(texts):
    ids = list(texts)
    low = {i: i for i in ids}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if similar(texts[i], texts[j]):
                a, b = root(i), root(j)
                low[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(at, f"ins{rng.randrange(10**6)}")
        elif len(words) > 5:
            del words[at]
    return words


@pytest.mark.parametrize("block", [4, 1024])
def test_classes_equal_brute_force(spark, block):
    rng = random.Random(5)
    texts = {}
    for g in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([20, 60]))]
        for _ in range(9):
            texts[len(texts) * 3] = " ".join(edited(rng, base, rng.randrange(5)))
    passage = [f"p{i}" for i in range(30)]
    for _ in range(12):
        own = [f"o{rng.randrange(10**6)}" for _ in range(14)]
        texts[len(texts) * 3] = " ".join(passage + own)
    texts |= {1000: "One TWO  three", 1001: "one two three", 1002: "one two", 1003: None, 1004: ""}
    texts |= {1005: "  ", 1006: "x " * 300, 1007: "x " * 301, 1008: "y " * 5, 1009: "x " * 3000}
    df = spark.createDataFrame(
        [(i, t, i) for i, t in texts.items()], "doc_id bigint, text string, class_id int"
    ).repartition(3)
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(df, block=block).collect()}
    assert got == brute(texts)


def test_given_table_against_exact_pairs(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.class_id for r in op7_minhash_neardup(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    arrays = {r.doc_id: nd.kmers(nd.words_of(r.text)).astype(np.uint32) for r in rows}
    assert set(got) == set(arrays)
    holders = {}
    for doc, x in arrays.items():
        for kmer in set(x.tolist()):
            holders.setdefault(kmer, []).append(doc)
    common = {}
    for docs in holders.values():
        for n, a in enumerate(docs):
            for b in docs[:n]:
                common[a, b] = common.get((a, b), 0) + 1
    low = {d: d for d in arrays}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in common:
        if nd.linked(arrays[a], arrays[b]):
            x, y = root(a), root(b)
            low[max(x, y)] = min(x, y)
    assert got == {d: root(d) for d in arrays}
    assert len(set(got.values())) < len(got)


def test_edges(spark):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(1, "a b c d e f", 0), (1, "a b c d e f", 0), (2, "a b c d e f", 0), (None, "a b c d e f", 0),
            (None, None, 0), (3, long, 0), (4, long + " end", 0), (5, "other text", 0), (5, "a b", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, content int")
    got = sorted(
        ((r.doc_id, r.class_id, r.kept) for r in nd.near_duplicates(df).collect()), key=str
    )
    assert got == sorted(
        [(1, 1, True), (1, 1, False), (2, 1, False), (None, None, True), (None, None, True),
         (3, 3, True), (4, 3, False), (5, 5, True), (5, 5, True)], key=str)
    assert nd.near_duplicates(df.limit(0)).count() == 0
    once = nd.keep_one_each(df)
    assert once.columns == df.columns
    assert sorted(r.doc_id or 0 for r in once.collect()) == [0, 0, 1, 3, 5, 5]


def test_repeated_ids_lose_no_text(spark):
    """60 rows of 40 texts under 7 ids: 40 rows survive, each text once."""
    texts = [f"text number {i} " + " ".join(f"w{i}x{j}" for j in range(12)) for i in range(40)]
    rows = [(i % 7, texts[i]) for i in range(40)] + [(i % 5, texts[i]) for i in range(20)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, nth int")
    kept = nd.keep_one_each(df.repartition(5))
    assert sorted(r.text for r in kept.collect()) == sorted(texts)
    found = nd.near_duplicates(df).collect()
    assert len(found) == 60 and sum(r.kept for r in found) == 40
    lowest = {t: min(i for i, x in rows if x == t) for t in texts}
    assert sorted((r.doc_id, r.class_id) for r in found) == sorted((i, lowest[t]) for i, t in rows)
    # Near copies under one id, spelt alike or not, still leave one row.
    base = " ".join(f"w{j}" for j in range(60))
    near = [(1, base), (1, base.upper()), (1, base + " end"), (1, base + " end"), (2, "start " + base)]
    one = nd.keep_one_each(spark.createDataFrame(near, "doc_id bigint, text string"))
    assert [r.doc_id for r in one.collect()] == [1]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 180)]
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.id: r.component for r in components(df).collect()}
    low = {x: x for pair in links for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    single = {a for a, b in links if a == b}
    assert got == {k: v for k, v in low.items() if k in got}
    assert set(low) - set(got) <= single
    assert components(df.limit(0)).count() == 0
