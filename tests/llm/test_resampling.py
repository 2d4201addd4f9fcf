"""Importance resampling against a computation in plain Python; its SQL is compared elsewhere."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from veilframe.llm import resampling as res

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, order):
    own = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(own), [" ".join(own[i : i + k]) for k in range(1, order + 1) for i in range(len(own) - k + 1)]


def brute(docs, target, order, buckets, percent=10, least=20):
    def place(feature):
        return zlib.crc32(feature.encode()) % buckets

    raw, aim = [0] * buckets, [0] * buckets
    for counts, texts in ((raw, [t for _, t in docs]), (aim, target)):
        for text in texts:
            for feature in runs(text, order)[1]:
                counts[place(feature)] += 1
    s, t = sum(raw) + buckets, sum(aim) + buckets
    gain = [math.floor(1000 * math.log((aim[b] + 1) * s / ((raw[b] + 1) * t))) for b in range(buckets)]
    rows = []
    for ident, text in docs:
        n, found = runs(text, order)
        weight = sum(gain[place(f)] for f in found)
        name = "" if ident is None else ident
        h = int(hashlib.sha256(f"2024:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((ident, len(found), weight, score, n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    rank = {id(r): i + 1 for i, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


@pytest.fixture(scope="module")
def given():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "ñ", "don't"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 19, 20, 21, 80])))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "-"), (None, "w1 " * 30), (303, "w2 " * 30_000)]
    docs += [docs[5]] * 3 + [(1000 + i, "the same long text " * 8) for i in range(150)]
    target = [" ".join(rng.choice(vocabulary[:60]) for _ in range(30)) for _ in range(40)] + [None, ""]
    return docs, target


@pytest.mark.parametrize("order,buckets", [(1, 10_000), (3, 64), (2, 10_000)])
def test_equals_brute_force(spark, given, order, buckets):
    docs, target = given
    found = res.resample(
        spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, score int"),
        spark.createDataFrame([(t,) for t in target], "text string"),
        order, buckets,
    )
    assert found.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, target, order, buckets)


def test_features_chain_their_checksums():
    given = [b"one", b"two", b"three"]
    expected = [b"one", b"two", b"three", b"one two", b"two three", b"one two three"]
    assert list(res.features(given, 3)) == [zlib.crc32(x) for x in expected]
    assert list(res.features([], 3)) == [] and len(list(res.features([b"one"], 3))) == 1


def test_held_counts_fold(spark, monkeypatch, given):
    texts = spark.createDataFrame([(t,) for _, t in given[0]], "text string")
    expected = res.dense(res.bucket_counts(texts, 2, 50), 50)
    plain = [0] * 50
    for _, text in given[0]:
        for feature in runs(text, 2)[1]:
            plain[zlib.crc32(feature.encode()) % 50] += 1
    assert expected.tolist() == plain


def test_draw_prefers_the_target(spark, given):
    docs, target = given
    found = res.resample(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame([(t,) for t in target], "text string"),
    )
    means = found.where("n_features >= 20").groupBy(F.col("rank").isNotNull().alias("drawn")).agg(F.avg("weight").alias("w"))
    by = {r.drawn: r.w for r in means.collect()}
    assert by[True] > by[False]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c " * 10)], "doc_id bigint, text string")
    assert res.resample(docs, some).count() == 0
    assert [r["rank"] for r in res.resample(some, docs).collect()] == [None]
    assert [r["rank"] for r in res.resample(some, docs, percent=100).collect()] == [1]
