"""Pack token streams into near-full windows by Karmarkar-Karp multiway differencing.

A task packs the documents of its own input split, a block of windows at a time, so
only tails are shuffled and a task holds one block whatever the split's size. Whole
windows of a long document are cut off first. What is left is cut into pieces of at
most `piece` tokens until a block is full: `windows` times the capacity less a small
slack. Differencing then keeps merging the two partial partitions with the largest
imbalances, largest bins against smallest, until one partition into `windows` bins is
left. If a bin exceeds the capacity, the block is packed again with pieces half as long, a
few times, as smaller pieces leave smaller imbalances; if that does not help, the number
of bins is raised by one. Neighbouring pieces in one window are one piece again.

What is left at the end of a split, less than a window, is its tail. The tails of about as many
splits as a block has windows go to one task of a second pass, which packs them in the same
way. Only what is left there is cut into sequences whose lengths are powers of two, which need
no padding: at most eleven for a capacity of 2048, and so few short ones in all.

A retried task reads the same split and gives the same windows and ids.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import stored_once

END_OF_DOCUMENT = 1
# How often pieces are halved before the number of windows is raised.
_FINER = 3
# Added to the task's number in sequence ids of the second pass.
_SECOND = 1 << 28
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


@functools.lru_cache(maxsize=2)
def encoder(tokenizer: str, ranks: str | None) -> Callable[[str], list[int]]:
    """Text -> ids of the tokenizer file.

    `ranks`, the same vocabulary as a rank file, serves a faster implementation with equal
    ids. It knows no special tokens, so texts that spell one go to the tokenizer itself.
    """
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokenizer)
    special = [t.content for t in full.get_added_tokens_decoder().values()]

    def slow(text: str) -> list[int]:
        return full.encode(text, add_special_tokens=False).ids

    if ranks is None:
        return slow
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(
        "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
    ).encode_ordinary
    return lambda text: slow(text) if any(s in text for s in special) else fast(text)


def differenced(sizes: np.ndarray, bins: int) -> list[list[int]]:
    """Members of each bin: Karmarkar-Karp differencing into `bins` bins.

    A partial partition is its bin sums, largest first, and for each bin a node of a
    forest of items. The two partitions with the largest spread are merged largest bin
    to smallest, so opposing imbalances cancel. Ties go to the earlier partition.
    """
    n = len(sizes)
    left = np.full(2 * n * 2, -1, dtype=np.int64)
    right = np.full(2 * n * 2, -1, dtype=np.int64)
    made = n
    heap = []
    for i in range(n):
        sums = np.zeros(bins, dtype=np.int64)
        nodes = np.full(bins, -1, dtype=np.int64)
        sums[0], nodes[0] = sizes[i], i
        heap.append((-int(sizes[i]) if bins > 1 else 0, i, sums, nodes))
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, other, theirs = heapq.heappop(heap)
        sums, theirs = sums + other[::-1], theirs[::-1]
        merged = np.where(nodes < 0, theirs, nodes)
        both = np.flatnonzero((nodes >= 0) & (theirs >= 0))
        if len(both):
            if made + len(both) > len(left):
                left = np.concatenate([left, np.full(len(left), -1, dtype=np.int64)])
                right = np.concatenate([right, np.full(len(right), -1, dtype=np.int64)])
            fresh = np.arange(made, made + len(both))
            left[fresh], right[fresh] = nodes[both], theirs[both]
            merged[both] = fresh
            made += len(both)
        by_size = np.argsort(-sums, kind="stable")
        sums, merged = sums[by_size], merged[by_size]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), order, sums, merged))
        order += 1
    members = []
    for node in heap[0][3].tolist() if heap else []:
        found, open_nodes = [], [node] if node >= 0 else []
        while open_nodes:
            k = open_nodes.pop()
            if k < n:
                found.append(k)
            else:
                open_nodes += [int(left[k]), int(right[k])]
        members.append(sorted(found))
    return members


def balanced(sizes: np.ndarray, capacity: int, bins: int) -> list[list[int]]:
    """Bins of at most `capacity`; their number starts at `bins` and rises until all fit."""
    while True:
        members = differenced(sizes, bins)
        if all(int(sizes[m].sum()) <= capacity for m in members):
            return [m for m in members if m]
        bins += 1


def recut(pieces: list[tuple], limit: int) -> list[tuple]:
    """Pieces (doc, start, ids, tokens) cut to at most `limit` ids, in order."""
    return [
        (doc, start + at, ids[at : at + limit], tokens)
        for doc, start, ids, tokens in pieces
        for at in range(0, len(ids), limit)
    ]


def joined(pieces: list[tuple]) -> list[tuple]:
    """Pieces of one window in order, those that continue one another made one.

    The ids of neighbours are views of one document's ids, which tells apart documents with
    equal ids.
    """
    groups: list[list[tuple]] = []
    for piece in pieces:
        _, start, ids, _ = piece
        if groups:
            _, before, held, _ = groups[-1][-1]
            if ids.base is held.base and ids.base is not None and before + len(held) == start:
                groups[-1].append(piece)
                continue
        groups.append([piece])
    return [
        (doc, start, group[0][2] if len(group) == 1 else np.concatenate([x[2] for x in group]), tokens)
        for group in groups
        for doc, start, _, tokens in group[:1]
    ]


def packed(
    documents: Iterator[tuple[int | None, int, np.ndarray, int]],
    capacity: int,
    windows: int,
    piece: int,
    slack: int,
    first_sequence: int,
    last_pass: bool,
) -> Iterator[tuple]:
    """(doc_id, start, ids, doc_tokens, sequence_id, offset) for each piece.

    Takes (doc_id, start, ids, doc_tokens) of documents or parts of them. The tail has no
    sequence, unless this is the last pass.
    """
    sequence = first_sequence
    held: list[tuple[int | None, int, np.ndarray, int]] = []
    total, full = 0, windows * (capacity - slack)

    def laid(bins: list[list[tuple]]) -> Iterator[tuple]:
        nonlocal sequence
        for members in bins:
            offset = 0
            for doc, start, ids, tokens in members:
                yield doc, start, ids, tokens, sequence, offset
                offset += len(ids)
            sequence += 1

    def closed(count: int) -> Iterator[tuple]:
        for shrink in range(_FINER + 1):
            parts = recut(held, max(1, piece >> shrink))
            sizes = np.array([len(x[2]) for x in parts], dtype=np.int64)
            members = differenced(sizes, count)
            if all(int(sizes[m].sum()) <= capacity for m in members):
                break
        else:
            parts = held
            sizes = np.array([len(x[2]) for x in parts], dtype=np.int64)
            members = balanced(sizes, capacity, count + 1)
        return laid([joined([parts[i] for i in m]) for m in members if m])

    def taken(room: int) -> list[tuple]:
        """The last `room` tokens of what is held, in order."""
        members = []
        while room:
            doc, start, ids, tokens = held.pop()
            keep = max(0, len(ids) - room)
            members.append((doc, start + keep, ids[keep:], tokens))
            room -= len(ids) - keep
            if keep:
                held.append((doc, start, ids[:keep], tokens))
        return joined(members[::-1])

    for doc, begin, ids, tokens in documents:
        at, size = 0, len(ids)
        while size - at >= capacity:
            yield from laid([[(doc, begin + at, ids[at : at + capacity], tokens)]])
            at += capacity
        for end in [*range(at + piece, size, piece), size] if at < size else []:
            while total + end - at >= full:
                cut = at + full - total
                held.append((doc, begin + at, ids[at:cut], tokens))
                yield from closed(windows)
                held, total, at = [], 0, cut
            if end > at:
                held.append((doc, begin + at, ids[at:end], tokens))
                total, at = total + end - at, end
    count = total // (capacity - slack)
    spare = total - count * (capacity - slack)
    if not last_pass:
        for member in taken(spare):
            yield *member, None, None
        spare = 0
    tail: list[list[tuple]] = []
    while spare:  # cut the end of the stream into sequences of 2^k tokens
        room = 1 << (spare.bit_length() - 1)
        spare -= room
        tail.append(taken(room))
    if held:
        yield from closed(count)
    yield from laid(tail)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    capacity: int = 2048,
    windows: int = 128,
    piece: int = 512,
    slack: int = 8,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document, with its sequence and offset there.

    Uses `doc_id` and `text` of `docs`; other columns are not read. Each row is a document
    of its own, also with a repeated or null id. A null or empty text has one token, the
    end mark. Sequences hold at most `capacity` tokens, filled from offset 0 without
    gaps; every token lies in exactly one piece. An empty table gives no rows. With
    `keep_ids` the piece's ids are returned too.
    """
    if capacity < 1 or piece < 1 or windows < 1 or not 0 <= slack < capacity:
        raise ValueError("capacity, piece and windows must be positive, slack below capacity")

    def packer(documents: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], last_pass: bool):
        def out(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, tokens, sequence, offset = zip(*rows, strict=True)
            # The ids of a tail go on to the second pass.
            carried = [x.tobytes() if keep_ids or s is None else None for x, s in zip(ids, sequence, strict=True)]
            columns = {
                "doc_id": pa.array(doc, pa.int64()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array([len(x) for x in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                "doc_tokens": pa.array(tokens, pa.int64()),
                "sequence_id": pa.array(sequence, pa.int64()),
                "offset": pa.array(offset, pa.int64()),
                "raw": pa.array(carried, pa.binary()),
                "split": pa.array([split] * len(rows), pa.int64()),
            }
            return pa.RecordBatch.from_pydict(columns)

        split = 0

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal split
            split = TaskContext.get().partitionId()
            # Sequences of the second pass are numbered apart from those of the first.
            first = (split + (_SECOND if last_pass else 0)) << 33
            rows: list[tuple] = []
            found = packed(documents(batches), capacity, windows, piece, slack, first, last_pass)
            for row in found:
                rows.append(row)
                if len(rows) >= 2000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

        return pack

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = encode(text.as_py() or "")
                ids.append(END_OF_DOCUMENT)
                yield doc, 0, np.array(ids, dtype="<u4"), len(ids)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                yield row["doc_id"], row["start"], np.frombuffer(row["raw"], dtype="<u4"), row["doc_tokens"]

    schema = SCHEMA + ", raw binary, split bigint"
    first = stored_once(
        docs.select("doc_id", "text").mapInArrow(packer(encoded, False), schema), "packing"
    )
    left = first.where("sequence_id is null")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-tokens // (windows * capacity)))
    second = (
        left.repartition(tasks, "split")
        .sortWithinPartitions("split", "doc_id", "start", "ids_crc32", "length")
        .mapInArrow(packer(tails, True), schema)
    )
    result = first.where("sequence_id is not null").unionByName(second)
    columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    if not keep_ids:
        return result.select(*columns)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in batch["raw"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in columns), pa.array(ids, pa.list_(pa.int32()))], [*columns, "ids"]
            )

    return result.select(*columns, "raw").mapInArrow(listed, SCHEMA + ", ids array<int>")
