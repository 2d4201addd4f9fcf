"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is its sequence of k-mers of `k` words. For each of `bands` random orders, the `ell`
smallest k-mers, told apart by occurrence number, are taken and put back into text order:
two texts agree in a band if they share these k-mers in the same order, so agreement
follows edit similarity. Texts that agree in a band are candidates. A pair is linked if a
banded alignment of its k-mer sequences matches m k-mers with m / (|a| + |b| - m) at least
`similarity`: Jaccard similarity of the k-mers that keep their order.

A pair at similarity s agrees in a band with about s^ell; with the defaults a pair at 0.8
is missed with probability (1 - 0.8^4)^16 = 0.0002.

Candidates are never expanded into all pairs:
1. Equal texts are one node. Each node is compared with the most central node of each of
   its buckets (the one whose buckets hold most rows), a few pairs a node.
2. Buckets of three or more nodes that are still in different classes are compared inside,
   a block of at most `block` nodes against another at a time. Within a block an inverted
   index gives every pair's shared k-mers; only pairs that may reach the similarity and are
   not yet connected are aligned, and only a spanning set of links leaves the task.
Only a bucket of g unconnected nodes costs g^2 / block rows; connected ones cost their rows.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.llm.common import stored_once, unused
from veilframe.llm.components import components

K, BANDS, ELL, SIMILARITY, BLOCK = 5, 16, 4, 0.8, 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; fixed multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def kmers(words: list[str], k: int = K) -> np.ndarray:
    """Hashes of the k-word windows; a text of fewer words has one, of all its words."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    width = min(k, len(hashed))
    out = np.zeros(len(hashed) - width + 1, dtype=np.uint64)
    for i in range(width):
        out = _mixed(out + _MIX) ^ hashed[i : i + len(out)]
    return _mixed(out)


def occurrence_labelled(shingles: np.ndarray) -> np.ndarray:
    """Hashes in which the n-th occurrence of a k-mer differs from the others."""
    shingles = shingles.astype(np.uint64, copy=False)
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    fresh = np.ones(len(ordered), dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    if fresh.all():
        return shingles
    at = np.arange(len(ordered))
    nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
    labels = np.empty(len(ordered), dtype=np.uint64)
    labels[order] = nth.astype(np.uint64)
    return shingles ^ (labels * _MIX)


def band_keys(shingles: np.ndarray, bands: int = BANDS, ell: int = ELL) -> np.ndarray:
    """Order MinHash: one 64-bit key per band; the bands' keys never collide by band."""
    n = len(shingles)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    labelled = occurrence_labelled(shingles)
    seeds = _mixed(np.arange(1, bands + 1, dtype=np.uint64) * _MIX)
    take = min(ell, n)
    keys = np.empty(bands, dtype=np.uint64)
    step = max(1, min(bands, 2_000_000 // n))  # bounds the memory of very long texts
    for first in range(0, bands, step):
        some = seeds[first : first + step]
        ranks = _mixed(labelled[None, :] ^ some[:, None])
        if take < n:
            places = np.argpartition(ranks, take - 1, axis=1)[:, :take]
        else:
            places = np.tile(np.arange(n), (len(some), 1))
        places.sort(axis=1)
        chosen = shingles[places]
        key = some.copy()
        for i in range(take):
            key = _mixed(key + _MIX) ^ chosen[:, i]
        keys[first : first + step] = _mixed(key)
    return keys.view(np.int64)


def least_matches(a: int, b: int, similarity: float) -> int:
    """Fewest matched k-mers with which texts of a and b k-mers reach the similarity."""
    return math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """K-mers in common, with multiplicity and without regard to order."""
    a, m = np.unique(a, return_counts=True)
    b, n = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(m[i], n[j]).sum())


def aligned_matches(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of k-mers whose places differ by at most `band`.

    Equal ends are matched off first. Then a bit vector over the window of the band moves
    along b, one bit per k-mer of a; bits that leave the window are final.
    """
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b, n = a[head:], b[head:], n - head
    if n == 0:
        return head
    same = a[::-1][:n] == b[::-1][:n]
    tail = n if same.all() else int(np.argmin(same))
    x, y = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    places: dict[int, list[int]] = {}
    for i, kmer in enumerate(x):
        places.setdefault(kmer, []).append(i)
    width = 2 * band + 1
    full = (1 << width) - 1
    state, matched = full, 0  # bit d: place j - band + d of x; 0 where a match ends
    for j, kmer in enumerate(y):
        if j:
            matched += 1 - (state & 1)
            state = (state >> 1) | (1 << (width - 1))
        found = places.get(kmer)
        if found:
            low = j - band
            mask = 0
            for i in found[bisect.bisect_left(found, low) : bisect.bisect_right(found, j + band)]:
                mask |= 1 << (i - low)
            if mask:
                both = state & mask
                state = ((state + both) | (state & ~mask)) & full
    return head + tail + matched + width - state.bit_count()


def linked(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the banded alignment reaches the similarity.

    A band of `longer - needed matches` loses nothing: a place can move by no more than
    the k-mers left unmatched.
    """
    if len(a) == 0 or len(b) == 0:
        return len(a) == len(b)
    need = least_matches(len(a), len(b), similarity)
    if need > min(len(a), len(b)) or shared(a, b) < need:
        return False
    return aligned_matches(a, b, max(len(a), len(b)) - need) >= need


def _spelling(text: str = "text"):
    """A hash of the text as it stands; with the id it finds the row of a text again."""
    return F.xxhash64(F.col(text))


def sketches(docs: DataFrame, k: int = K, bands: int = BANDS, ell: int = ELL) -> DataFrame:
    """doc_id, spelling, content (128-bit hash of the words), keys: a row per row of `docs`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, keys = [], []
            for text in batch["text"]:
                words = words_of(text.as_py())
                contents.append(xxhash.xxh3_128_digest("\n".join(words)))
                keys.append(band_keys(kmers(words, k), bands, ell))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["spelling"], pa.array(contents, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "spelling", "content", "keys"],
            )

    return docs.select("doc_id", _spelling().alias("spelling"), "text").mapInArrow(
        rows, "doc_id bigint, spelling bigint, content binary, keys array<bigint>"
    )


def _with_kmers(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, kmers) of the wanted nodes; `nodes` has node, content and its first row.

    32 bits of each k-mer's hash are kept: within a pair of texts that tells them apart.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            kept, arrays = [], []
            for node, content, text in zip(
                batch["node"].to_pylist(), batch["content"].to_pylist(), batch["text"], strict=True
            ):
                words = words_of(text.as_py())
                # A row may be repeated; the join puts its copies side by side.
                if node != last and xxhash.xxh3_128_digest("\n".join(words)) == content:
                    last = node
                    kept.append(node)
                    arrays.append(kmers(words, k).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept, pa.int64()), pa.array(arrays, pa.binary())], ["node", "kmers"]
            )

    texts = docs.select(F.col("doc_id").alias("_id"), _spelling().alias("_spelling"), "text")
    first = nodes.select("node", "content", "first.doc_id", "first.spelling").hint("merge")
    same = (F.col("_id") == F.col("doc_id")) & (F.col("_spelling") == F.col("spelling"))
    return (
        texts.join(first, same)
        .select("node", "content", "text")
        .mapInArrow(rows, "node bigint, kmers binary")
    )


def _verified(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs whose k-mers align; `pairs` has a, b, ka, kb."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                linked(
                    np.frombuffer(x.as_buffer(), dtype=np.uint32),
                    np.frombuffer(y.as_buffer(), dtype=np.uint32),
                    similarity,
                )
                for x, y in zip(batch["ka"], batch["kb"], strict=True)
            ]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b", "ka", "kb").mapInArrow(rows, "a bigint, b bigint")


def block_links(
    nodes: list[int],
    sides: list[int],
    classes: list[int],
    arrays: list[np.ndarray],
    similarity: float,
) -> list[tuple[int, int]]:
    """Links that join the classes of a block as its links do, found within the block.

    Pairs of one side are compared if there is one side, else pairs of different sides.
    """
    n = len(nodes)
    parent = {c: c for c in classes}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    one_side = len(set(sides)) == 1
    labelled = [occurrence_labelled(x) for x in arrays]
    sizes = np.array([len(x) for x in arrays], dtype=np.int64)
    index, inverse = np.unique(np.concatenate(labelled), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(inverse, kind="stable")
    posted = owner[order]
    bounds = np.searchsorted(inverse[order], np.arange(len(index) + 1))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for i in range(n):
        mine = inverse[ends[i] : ends[i + 1]]
        lists = [posted[bounds[t] : bounds[t + 1]] for t in mine.tolist()]
        if not lists:
            continue
        common = np.bincount(np.concatenate(lists), minlength=n)
        both = sizes + sizes[i]
        possible = np.flatnonzero(common * (1 + similarity) >= similarity * both - 1e-6)
        for j in possible[possible > i].tolist():
            if not one_side and sides[i] == sides[j]:
                continue
            ri, rj = root(classes[i]), root(classes[j])
            if ri != rj and linked(arrays[i], arrays[j], similarity):
                parent[max(ri, rj)] = min(ri, rj)
                out.append((nodes[i], nodes[j]))
    return out


def _blocks_linked(rows: DataFrame, similarity: float) -> DataFrame:
    """Links within each (key, x, y) block; rows come sorted by it and are streamed."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[tuple]) -> list[tuple[int, int]]:
            node, side, cls, raw = zip(*held, strict=True)
            arrays = [np.frombuffer(r, dtype=np.uint32) for r in raw]
            return block_links(list(node), list(side), list(cls), arrays, similarity)

        current, held = None, []
        for batch in batches:
            links = []
            columns = [batch[c].to_pylist() for c in ("key", "x", "y", "node", "side", "class", "kmers")]
            for key, x, y, *row in zip(*columns, strict=True):
                if (key, x, y) != current:
                    if len(held) > 1:
                        links += found(held)
                    current, held = (key, x, y), []
                held.append(tuple(row))
            if links:
                yield pa.RecordBatch.from_pylist(
                    [{"a": a, "b": b} for a, b in links], pa.schema({"a": pa.int64(), "b": pa.int64()})
                )
        if len(held) > 1 and (links := found(held)):
            yield pa.RecordBatch.from_pylist(
                [{"a": a, "b": b} for a, b in links], pa.schema({"a": pa.int64(), "b": pa.int64()})
            )

    return rows.mapInArrow(stream, "a bigint, b bigint")


def _classed(
    docs: DataFrame,
    k: int = K,
    bands: int = BANDS,
    ell: int = ELL,
    similarity: float = SIMILARITY,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, spelling, rows, class_id, survives: a row per id and text of `docs`.

    `rows` is how often they stand together, `survives` marks one of them per class: the
    smallest id, and of texts under the same id one fixed by its hash. Rows with a null id
    have a null class and survive.
    """
    sketched = stored_once(sketches(docs, k, bands, ell), "neardup-sketches")
    # A node is a text, whichever and however many ids it has. Its number is written with it.
    nodes = stored_once(
        sketched.where(F.col("doc_id").isNotNull())
        .groupBy("content")
        .agg(F.min(F.struct("doc_id", "spelling")).alias("first"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id()),
        "neardup-nodes",
    )
    rows = nodes.select("node", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = stored_once(rows.join(sizes, "key"), "neardup-buckets")
    wanted = buckets.select("node").distinct()
    arrays = stored_once(
        _with_kmers(docs, nodes.select("node", "content", "first").join(wanted, "node"), k),
        "neardup-kmers",
    )

    # 1. Each node against the most central node of its buckets.
    central = buckets.groupBy("node").agg(F.sum("size").alias("central"))
    leaders = (
        buckets.join(central, "node")
        .groupBy("key")
        .agg(F.max_by("node", F.struct(F.col("central"), -F.col("node"))).alias("leader"))
    )
    pairs = (
        buckets.join(leaders, "key")
        .where(F.col("node") != F.col("leader"))
        .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
        .distinct()
    )
    with_arrays = pairs.join(
        arrays.select(F.col("node").alias("a"), F.col("kmers").alias("ka")), "a"
    ).join(arrays.select(F.col("node").alias("b"), F.col("kmers").alias("kb")), "b")
    first = stored_once(_verified(with_arrays, similarity), "neardup-links")

    # 2. Buckets whose nodes are still apart, block against block.
    so_far = components(first)
    classed = buckets.where("size > 2").join(
        so_far.select(F.col("id").alias("node"), F.col("component").alias("_c")), "node", "left"
    ).select("key", "node", "size", F.coalesce("_c", "node").alias("class"))
    apart = (
        classed.groupBy("key")
        .agg(F.min("class").alias("_low"), F.max("class").alias("_high"))
        .where("_low < _high")
        .select("key")
    )
    parts = F.ceil(F.col("size") / F.lit(block)).cast("int")
    placed = (
        classed.join(apart, "key")
        .withColumn("parts", parts)
        .withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .join(arrays, "node")
        .select(
            "key",
            F.least("side", "other").alias("x"),
            F.greatest("side", "other").alias("y"),
            "node",
            "side",
            "class",
            "kmers",
        )
        .repartition("key", "x", "y")
        .sortWithinPartitions("key", "x", "y", "node")
    )
    second = stored_once(_blocks_linked(placed, similarity), "neardup-links")

    merged = components(first.union(second))
    of_node = nodes.join(merged, F.col("node") == F.col("id"), "left").select(
        "content", "first", F.coalesce("component", "node").alias("class")
    )
    heads = of_node.groupBy(F.col("class").alias("_class")).agg(F.min("first").alias("head"))
    of_content = of_node.join(heads, F.col("class") == F.col("_class")).select("content", "head")
    rows = (
        sketched.where(F.col("doc_id").isNotNull())
        .groupBy("content", "doc_id", "spelling")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    known = rows.join(of_content, "content").select(
        "doc_id",
        "spelling",
        "rows",
        F.col("head.doc_id").alias("class_id"),
        (F.col("head") == F.struct("doc_id", "spelling")).alias("survives"),
    )
    alone = sketched.where(F.col("doc_id").isNull()).select(
        "doc_id",
        "spelling",
        F.lit(1).cast("bigint").alias("rows"),
        F.lit(None).cast("bigint").alias("class_id"),
        F.lit(True).alias("survives"),
    )
    return known.union(alone)


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, class_id, kept: one row per row of `docs`.

    class_id is the smallest id of the class, kept marks one row of it: of that id, and if rows
    of the class repeat it, one of those. Texts with equal words are copies, so all null,
    empty and blank texts form one class. Rows with equal ids and different texts are documents
    of their own, each with the class of its text. A row with a null id stands alone: class_id
    null, kept true. An empty table gives no rows. Uses doc_id and text; other columns are
    not read. `settings` are k, bands, ell, similarity and block.
    """
    classed = _classed(docs, **settings)
    nth = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("nth")
    return classed.select("doc_id", "class_id", "survives", nth).select(
        "doc_id", "class_id", (F.col("survives") & (F.col("nth") == 1)).alias("kept")
    )


def keep_one_each(docs: DataFrame, **settings) -> DataFrame:
    """`docs` with one row of each class, as `near_duplicates` keeps it.

    No text is lost because its id stands at another one too. Rows with null ids stay, all
    columns unchanged.
    """
    one, hashed, nth = unused(docs, "_kept", "_hashed", "_nth")
    survivors = (
        _classed(docs, **settings)
        .where("survives and doc_id is not null")
        .select(F.col("doc_id").alias(one), F.col("spelling").alias(hashed))
    )
    same = (F.col("doc_id") == F.col(one)) & (_spelling() == F.col(hashed))
    numbered = (
        docs.where(F.col("doc_id").isNotNull())
        .join(survivors, same)
        .withColumn(nth, F.row_number().over(W.partitionBy(one, hashed).orderBy(one)))
        .where(F.col(nth) == 1)
        .select(*docs.columns)
    )
    return numbered.union(docs.where(F.col("doc_id").isNull()))
