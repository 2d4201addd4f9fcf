"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Texts become lower-case words. Every run of `size` consecutive words of a benchmark text is
a window; a shorter text is one window. The windows' hashes and exact words are broadcast
as a table; each document's windows are hashed in one vectorised pass, looked up, and
every hit is verified word by word. Words inside a verified window are hit.

The broadcast has a size bound. Windows are measured first; beyond `slice_bytes` they are
dealt into as many slices as keep each below twice the bound, every slice is scanned in a
job of its own, and the hits of a document are merged. So nothing depends on how
large the benchmark is, except time.

Nothing is shuffled to find hits, so passages that many documents share heat no key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import stored_once, unused
from veilframe.llm.words import places, words

SIZE = 10
SLICE_BYTES = 32 << 20
# What a window takes besides its words: hash, offsets, item reference.
_WINDOW_BYTES = 40
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_RANGES = "array<struct<first:bigint,last:bigint>>"


def window_hashes(given: list[bytes], lengths: Iterable[int]) -> dict[int, np.ndarray]:
    """For each length, the hashes of all windows of so many words, in order."""
    mixed = np.fromiter(map(zlib.crc32, given), np.uint64, len(given)) * _MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    out = {}
    for length in lengths:
        count = len(given) - length + 1
        if count <= 0:
            continue
        total = np.full(count, length, dtype=np.uint64)
        for k in range(length):
            total *= _STEP
            total += mixed[k : k + count]
        out[length] = total ^ (total >> np.uint64(31))
    return out


@dataclass(frozen=True)
class Windows:
    """A slice of the benchmark's windows: sorted hashes, exact words, items of each window."""

    lengths: tuple[int, ...]
    hashes: np.ndarray
    starts: np.ndarray
    text: bytes
    item_starts: np.ndarray
    items: np.ndarray
    names: tuple[str | None, ...]
    shift: np.uint64
    seen: np.ndarray

    def hits(self, given: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged word ranges inside occurring windows, and the places of their items."""
        ranges, items, checked = [], [], set()
        for length, hashes in window_hashes(given, self.lengths).items():
            maybe = np.flatnonzero(self.seen[hashes >> self.shift])
            if len(maybe) == 0:
                continue
            at = np.searchsorted(self.hashes, hashes[maybe])
            for j, g in zip(maybe.tolist(), at.tolist(), strict=True):
                value = hashes[j]
                while g < len(self.hashes) and self.hashes[g] == value:
                    window = b" ".join(given[j : j + length])
                    if self.text[self.starts[g] : self.starts[g + 1]] == window:
                        ranges.append((j, j + length))
                        if g not in checked:
                            checked.add(g)
                            items.append(self.items[self.item_starts[g] : self.item_starts[g + 1]])
                        break
                    g += 1
        return merged(ranges), set(np.concatenate(items).tolist()) if items else set()


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges as disjoint ranges in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def benchmark_windows(
    benchmark: DataFrame, size: int = SIZE, ident: str = "item_id", text: str = "text"
) -> DataFrame:
    """length, hash, window, item: the distinct windows of each item."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["length", "hash", "window", "item"]
        for batch in batches:
            for item, given in zip(batch["item"].to_pylist(), batch["text"], strict=True):
                found = words(given.as_py())
                length = min(size, len(found))
                if length == 0:
                    continue
                hashes = window_hashes(found, (length,))[length]
                n = len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([length] * n, pa.int32()), pa.array(hashes.view(np.int64)),
                     pa.array([b" ".join(found[j : j + length]) for j in range(n)], pa.binary()),
                     pa.array([item] * n, pa.string())],
                    names,
                )

    given = benchmark.select(
        F.col(ident).cast("string").alias("item"), F.col(text).cast("binary").alias("text")
    )
    return given.mapInArrow(rows, "length int, hash bigint, window binary, item string").distinct()


def as_table(found: pa.Table) -> Windows:
    """The rows of `benchmark_windows`, in any order, as a table to look windows up in."""
    lengths = tuple(sorted(set(found["length"].to_pylist())))
    hashes = found["hash"].to_numpy().view(np.uint64)
    texts = found["window"].to_pylist()
    given = found["item"].to_pylist()
    names = tuple(sorted(set(given), key=lambda x: (x is None, x or "")))
    number = {name: i for i, name in enumerate(names)}
    order = sorted(range(len(texts)), key=lambda i: (hashes[i], texts[i]))
    firsts = [
        k for k, i in enumerate(order)
        if k == 0 or hashes[i] != hashes[order[k - 1]] or texts[i] != texts[order[k - 1]]
    ]
    kept = [order[k] for k in firsts]
    starts = np.zeros(len(kept) + 1, dtype=np.int64)
    np.cumsum([len(texts[i]) for i in kept], out=starts[1:])
    own = hashes[kept] if kept else np.zeros(0, np.uint64)
    bits = max(10, (16 * max(1, len(kept))).bit_length())
    shift = np.uint64(64 - bits)
    seen = np.zeros(1 << bits, dtype=bool)
    seen[own >> shift] = True
    return Windows(
        lengths, own, starts, b"".join(texts[i] for i in kept),
        np.array([*firsts, len(order)], dtype=np.int64),
        np.array([number[given[i]] for i in order], dtype=np.int64), names, shift, seen,
    )


def sliced(windows: DataFrame, slice_bytes: int) -> list[DataFrame]:
    """The windows in slices, each measured to take less than twice `slice_bytes`."""
    size = F.sum(F.length("window") + F.lit(_WINDOW_BYTES))
    total = windows.agg(size).first()[0] or 0
    count = max(1, -(-total // slice_bytes))
    while count > 1:
        part = F.pmod(F.xxhash64("window", "item"), F.lit(count))
        largest = windows.groupBy(part.alias("part")).agg(size.alias("b")).agg(F.max("b")).first()[0]
        if largest < 2 * slice_bytes:
            return [windows.where(part == k) for k in range(count)]
        if count > 4 * -(-total // slice_bytes):
            raise ValueError("a benchmark window is larger than the broadcast may be")
        count *= 2
    return [windows]


def _cut(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text without the words of the ranges and what stands between them."""
    at = places(text)
    parts, end = [], 0
    for first, last in ranges:
        parts.append(text[end : at[first][0]])
        end = at[last - 1][1]
    parts.append(text[end:])
    return b"".join(parts)


def _answers(
    texts: list[bytes | None], found: list[tuple[list, Iterable[str | None]]], cut: bool
) -> list[pa.Array]:
    """Columns of `_EXTRA` for texts and their (ranges, items)."""
    ranges = [r for r, _ in found]
    out = [
        pa.array([len(words(t)) for t in texts], pa.int64()),
        pa.array([sum(b - a for a, b in r) for r in ranges], pa.int64()),
        pa.array([sorted({i for i in items if i is not None}) for _, items in found], pa.list_(pa.string())),
    ]
    if cut:
        left = [_cut(t, r) if r else t for t, r in zip(texts, ranges, strict=True)]
        out.append(pa.array(left, pa.binary()))
    return out


def _finder(table: Broadcast):
    """row, ranges, items of the rows with a hit in one broadcast slice."""
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    kinds = (pa.int64(), span, pa.list_(pa.string()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table.value
        for batch in batches:
            out = []
            for number, given in zip(batch["row"].to_pylist(), batch["text"], strict=True):
                ranges, items = own.hits(words(given.as_py()))
                if ranges:
                    pairs = [{"first": a, "last": b} for a, b in ranges]
                    out.append((number, pairs, [own.names[i] for i in items]))
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
                    ["row", "ranges", "items"],
                )

    return find


def _scanned(docs: DataFrame, text: str, extra: list[str], windows: list[DataFrame], cut: bool) -> DataFrame:
    """`docs` without `text` (binary), with the columns named in `extra` after it."""
    spark = docs.sparkSession
    kinds = ["bigint", "bigint", "array<string>", "binary"][: len(extra)]
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType(
        kept + [T.StructField(n, T.DataType.fromDDL(k)) for n, k in zip(extra, kinds, strict=True)]
    )
    names = schema.names

    if len(windows) == 1:
        table = spark.sparkContext.broadcast(as_table(windows[0].toArrow()))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = table.value
            for batch in batches:
                texts = batch[text].to_pylist()
                found = []
                for given in texts:
                    ranges, items = own.hits(words(given))
                    found.append((ranges, [own.names[i] for i in items]))
                rest = [batch[f.name] for f in kept]
                yield pa.RecordBatch.from_arrays([*rest, *_answers(texts, found, cut)], names)

        return docs.mapInArrow(scan, schema)

    # Each slice is a broadcast of its own, so hits are written and merged by row.
    (row,) = unused(docs, "_row")
    numbered = stored_once(
        docs.withColumn(row, F.monotonically_increasing_id()), "decontamination-rows"
    )
    given = numbered.select(F.col(row).alias("row"), F.col(text).alias("text"))
    parts = []
    for one in windows:
        table = spark.sparkContext.broadcast(as_table(one.toArrow()))
        hits = given.mapInArrow(_finder(table), f"row bigint, ranges {_RANGES}, items array<string>")
        parts.append(stored_once(hits, "decontamination-hits"))
        table.unpersist()
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    of, ranges, items = unused(numbered, "_of", "_ranges", "_items")
    # A row has at most one entry per slice.
    together = union.groupBy(F.col("row").alias(of)).agg(
        F.flatten(F.collect_list("ranges")).alias(ranges),
        F.flatten(F.collect_list("items")).alias(items),
    )
    joined = numbered.join(together, F.col(row) == F.col(of), "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (merged((x["first"], x["last"]) for x in r or ()), i or ())
                for r, i in zip(batch[ranges].to_pylist(), batch[items].to_pylist(), strict=True)
            ]
            rest = [batch[f.name] for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*rest, *_answers(batch[text].to_pylist(), found, cut)], names
            )

    return joined.mapInArrow(finish, schema)


def _windows(benchmark: DataFrame, size: int, slice_bytes: int) -> list[DataFrame]:
    return sliced(stored_once(benchmark_windows(benchmark, size), "decontamination-windows"), slice_bytes)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    size: int = SIZE,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_hit, items of every row of `docs`.

    `n_hit` counts the words inside any occurrence of a benchmark window; `items` are the
    item ids, as strings in order and each once, of which a window occurs. Null and empty texts
    have no words. Repeated rows are answered each; null ids are kept. Benchmark rows
    with the same id are one item; those with a null id mark words but are not listed; those
    without words have no window. An empty benchmark hits nothing, an empty table gives no
    rows. Other columns are not read.
    """
    given = docs.select(F.col(ident), F.col(text).cast("binary").alias("_text"))
    return _scanned(
        given, "_text", ["n_words", "n_hit", "items"], _windows(benchmark, size, slice_bytes), False
    )


def remove_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    size: int = SIZE,
    max_share: float = 0.0,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The rows of `docs` with at most `max_share` of their words hit; columns unchanged.

    Texts without words stay. Nulls, repeats and empty tables as in `contamination`.
    """
    (own,) = unused(docs, "_own_text")
    extra = unused(docs, "_n_words", "_n_hit", "_items")
    kept = _scanned(
        docs.withColumn(own, F.col(text).cast("binary")), own, extra,
        _windows(benchmark, size, slice_bytes), False,
    )
    limit: Column = F.col(extra[0]) * F.lit(max_share)
    return kept.where(F.col(extra[1]) <= limit).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    size: int = SIZE,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """All rows of `docs`, hit words and what stands between them cut out of the text.

    Only the text changes, and only of rows with a hit; null stays null. Repeats and empty
    tables as in `contamination`.
    """
    extra = unused(docs, "_n_words", "_n_hit", "_items", "_left")
    cut = _scanned(
        docs.withColumn(text, F.col(text).cast("binary")), text, extra,
        _windows(benchmark, size, slice_bytes), True,
    )
    return cut.select(
        *[F.col(extra[3]).cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    )


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from `contamination`'s rows."""
    return scanned.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
