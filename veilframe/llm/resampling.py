"""Importance resampling of documents towards a target by hashed word n-grams.

Texts become lower-case words by translating and splitting their bytes. A feature is a run
of 1 to `order` consecutive words joined by one blank; its bucket is the crc32 of its bytes
modulo `buckets`, longer runs extending the shorter one's checksum. Feature counts per
bucket of the raw documents and of the target give each bucket a gain in thousandths
of a nat, add-one smoothed; a document's weight is the sum over its features. Adding
Gumbel noise fixed by the id and drawing the highest scores samples without replacement in
proportion to exp(weight).

Documents are read twice, for counts and for weights, and are not shuffled. Ranks come from
counts per score, added up in blocks of scores, so no task sees the whole table.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.llm.common import stored_once
from veilframe.llm.words import words

ORDER = 1
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
_HELD = 1 << 20
# Scores per block: a window over counts holds at most 2^10 rows.
_BLOCK_BITS = 10


def features(given: list[bytes], order: int = ORDER) -> Iterator[int]:
    """Checksums of all runs of 1 to `order` words, repeats included."""
    level = list(map(zlib.crc32, given))
    yield from level
    for k in range(1, order):
        level = [zlib.crc32(b" " + w, seed) for seed, w in zip(level, given[k:], strict=False)]
        yield from level


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of column `text` fall into each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, dtype=np.int64)
        held: Counter[int] = Counter()

        def fold() -> None:
            keys = np.fromiter(held.keys(), np.int64, len(held)) % buckets
            np.add.at(totals, keys, np.fromiter(held.values(), np.int64, len(held)))
            held.clear()

        for batch in batches:
            for text in batch["text"]:
                held.update(features(words(text.as_py()), order))
                if len(held) > _HELD:
                    fold()
        fold()
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(totals[some])], ["bucket", "n"]
        )

    rows = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(
        count, "bucket int, n bigint"
    )
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def dense(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """All bucket counts as an array; `counts` has at most `buckets` rows."""
    found = counts.toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each of B buckets."""
    size = len(raw)
    of_raw, of_target = int(raw.sum()) + size, int(target.sum()) + size
    return np.array(
        [
            math.floor(1000 * math.log(float(t + 1) * float(of_raw) / (float(s + 1) * float(of_target))))
            for s, t in zip(raw.tolist(), target.tolist(), strict=True)
        ],
        dtype=np.int64,
    )


def noise(ident: str, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, fixed by the id."""
    drawn = int(hashlib.sha256(f"{seed}:{ident}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((drawn + 0.5) / 4294967296)))


def weighted(
    docs: DataFrame, gain: np.ndarray, order: int = ORDER, seed: int = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight, total = [], [], [], []
            for ident, text in zip(batch["name"].to_pylist(), batch["text"], strict=True):
                given = words(text.as_py())
                places = np.fromiter(features(given, order), np.int64) % len(gain)
                own = int(gain[places].sum())
                n_words.append(len(given))
                n_features.append(len(places))
                weight.append(own)
                total.append(own + noise(ident or "", seed))
            columns = [pa.array(c, pa.int64()) for c in (n_words, n_features, weight, total)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *columns], ["doc_id", "n_words", "n_features", "weight", "score"]
            )

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    given = docs.select(
        "doc_id", F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("text")
    )
    return given.mapInArrow(
        score, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint"
    )


def _before(counts: DataFrame, place: str, n: str, levels: int) -> DataFrame:
    """place, before: the rows at all smaller places, added up block by block."""
    if levels == 0:
        earlier = W.orderBy(place).rowsBetween(W.unboundedPreceding, -1)
        return counts.select(place, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("before"))
    block = f"block{levels}"
    blocked = counts.withColumn(block, F.shiftright(F.col(place), _BLOCK_BITS))
    totals = blocked.groupBy(block).agg(F.sum(n).alias(f"n{levels}"))
    bases = _before(totals, block, f"n{levels}", levels - 1).withColumnRenamed("before", "base")
    earlier = W.partitionBy(block).orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    return blocked.join(bases, block).select(
        place, (F.col("base") + F.coalesce(F.sum(n).over(earlier), F.lit(0))).alias("before")
    )


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """`scored` with `rank`: 1, 2, ... by falling score, then smaller id; null where not drawn.

    Of the rows with at least `least_words` words, floor(percent% of them) are drawn.
    """
    place = F.when(F.col("n_words") >= least_words, -F.col("score"))
    placed = scored.withColumn("place", place)
    able = placed.where("place is not null")
    counts = able.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    before = _before(counts, "place", "n", 2)
    total = able.count()
    wanted = total * percent // 100
    within = W.partitionBy("place").orderBy(F.col("doc_id").asc_nulls_last(), "weight", "n_features")
    number = F.col("before") + F.row_number().over(within)
    ranked = able.join(before, "place").withColumn("number", number)
    rank = F.when(F.col("number") <= F.lit(wanted), F.col("number")).cast("bigint")
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank")).unionByName(
        placed.where("place is null").select(*columns, F.lit(None).cast("bigint").alias("rank"))
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    order: int = ORDER,
    buckets: int = BUCKETS,
    seed: int = SEED,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of `docs`.

    Null and empty texts have no features, weight 0 and no rank; they still have a score. A null
    id draws as an empty one and comes last among ties. Rows that repeat an id with equal
    scores take consecutive ranks, by weight and features. Without target texts all gains follow from
    the raw counts alone. An empty table gives no rows. Other columns are not read.
    """
    texts = docs.select("doc_id", "text")
    gain = gains(
        dense(bucket_counts(texts, order, buckets), buckets),
        dense(bucket_counts(target.select("text"), order, buckets), buckets),
    )
    return drawn(stored_once(weighted(texts, gain, order, seed), "resampling-scores"), percent, least_words)
