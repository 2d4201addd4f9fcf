"""Exact top-k inner products by best-first search in M-trees.

The table is indexed block by block: a task turns `block_rows` rows of its split into one
M-tree, a row of the index table. Nodes are pages of at most `page` entries with a routing
vector, a covering radius, and the stored distance to the routing vector of the parent.

Inner products are bounded by distances: for a node with routing vector c and radius r,
q.v <= q.c + |q| r for all v in it, and q.c <= q.p + |q| d(c, p) with the parent's p. The
second bound costs no product, so a child none of whose queries can gain is dropped
before its own is computed; entries of a leaf are dropped by their stored distances alike.
Nodes are opened by the best bound any query of the block has. A bound equal to the k-th
score is followed, since ties go to the smaller id.

Trees are dealt into lanes and queries into groups; a task holds the queries of a group and
reads the trees of a lane one after the other, carrying each query's k best rows along. Nothing
is joined, so nothing is ever broadcast, and copies of queries weigh about as much as the trees.
Trees are searched in rounds, each over four times as many trees as all before; a round starts
from every query's k-th score so far, so only rows that reach it leave a task, about 4 k a query
and round, however many trees there are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.llm.common import stored_once

_LOW, _HIGH = -(2**63), 2**63 - 1

# Products taken at once, and bytes of queries and their answers that a task holds.
_PRODUCTS = 1 << 20
_HELD = 64 << 20


@dataclass
class MTree:
    """Node i covers rows[first[i]:last[i]]; its children are nodes kids[i][0]..kids[i][1]-1."""

    rows: np.ndarray  # vectors, in tree order
    ids: np.ndarray
    own: np.ndarray  # distance of each row to the routing vector of its leaf
    route: np.ndarray  # routing vector of each node
    radius: np.ndarray
    parent: np.ndarray  # distance of each node's routing vector to its parent's
    kids: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @cached_property
    def norm(self) -> float:
        """Of the longest row."""
        real = self.rows.astype(np.float64)
        return float(np.sqrt(np.einsum("ij,ij->i", real, real).max(initial=0.0)))

    @cached_property
    def singles(self) -> np.ndarray:
        return self.rows.astype(np.float32)

    @cached_property
    def doubles(self) -> np.ndarray:
        return self.rows.astype(np.float64)

    @cached_property
    def reach(self) -> float:
        """No row lies farther from the origin, by routing vectors and radii."""
        return float(np.sqrt((self.route**2).sum(axis=1)).max() + self.radius.max())


def _distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    gap = rows - point
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def build_tree(ids: np.ndarray, vectors: np.ndarray, page: int = 64, fan_out: int = 8) -> MTree:
    """Bulk-load: rows go to the nearest of `fan_out` far-apart rows until they fit a page."""
    real = vectors.astype(np.float64)
    order: list[np.ndarray] = []
    nodes: list[dict] = []
    placed = 0
    queue: list[tuple[np.ndarray, int]] = [(np.arange(len(ids)), -1)]
    # Children of a node are made together, so they are neighbours; leaves take their rows
    # when reached, depth first within the queue's order.
    at = 0
    while at < len(queue):
        members, up = queue[at]
        mine = real[members]
        centre = mine[np.argmin(_distances(mine, mine.mean(axis=0)))]
        reach = _distances(mine, centre)
        node = {"route": centre, "radius": reach.max(), "kids": (0, 0), "first": 0, "last": 0,
                "parent": 0.0 if up < 0 else float(np.linalg.norm(centre - nodes[up]["route"]))}
        nodes.append(node)
        if len(members) <= page or node["radius"] == 0.0:
            node["first"], node["last"] = placed, placed + len(members)
            placed += len(members)
            order.append(members)
            node["own"] = reach
        else:
            pivots = [int(np.argmax(reach))]
            nearest = _distances(mine, mine[pivots[0]])
            owner = np.zeros(len(members), dtype=np.int64)
            while len(pivots) < fan_out:
                far = int(np.argmax(nearest))
                if nearest[far] == 0.0:
                    break
                gap = _distances(mine, mine[far])
                owner = np.where(gap < nearest, len(pivots), owner)
                nearest = np.minimum(nearest, gap)
                pivots.append(far)
            groups = [members[owner == g] for g in range(len(pivots))]
            groups = [g for g in groups if len(g)]
            node["kids"] = (len(queue), len(queue) + len(groups))
            queue += [(g, at) for g in groups]
        at += 1
    flat = np.concatenate(order) if order else np.arange(0)
    leaves = [n["own"] for n in nodes if "own" in n]
    return MTree(
        vectors[flat],
        ids[flat],
        np.concatenate(leaves) if leaves else np.zeros(0),
        np.stack([n["route"] for n in nodes]),
        np.array([n["radius"] for n in nodes]),
        np.array([n["parent"] for n in nodes]),
        np.array([n["kids"] for n in nodes]),
        np.array([n["first"] for n in nodes]),
        np.array([n["last"] for n in nodes]),
    )


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """a @ b.T of integer vectors, in their type if that is exact; beyond 64 bits the nearest
    64-bit number."""
    if exact:
        return a @ b.T
    whole = a.astype(object) @ b.astype(object).T
    return np.clip(whole, _LOW, _HIGH).astype(np.int64)


def _at_most(score: np.ndarray) -> np.ndarray:
    """Doubles not above the scores; beyond 2^53 a double may lie above the score it stands for."""
    real = score.astype(np.float64)
    return np.where(np.abs(real) < 2**53, real, np.nextafter(real, -np.inf))


def _where(mask: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    return arrays if mask.all() else tuple(x[mask] for x in arrays)


class Asked:
    """A block of queries with the k best rows found so far, over any number of trees.

    Of a query with a floor, only rows that reach it are wanted; its own row, known by its id,
    is left out.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None):
        real = rows.astype(np.float64)
        self.rows, self.ids, self.k = rows, ids, k
        self.norms = np.sqrt((real * real).sum(axis=1))
        self.worst = np.full(len(ids), -np.inf)  # k-th score so far, or the floor
        if floors is not None:
            self.worst = np.where(floors == _LOW, -np.inf, _at_most(floors))
        self.count = np.zeros(len(ids), dtype=np.int64)
        self.best_scores = np.zeros((len(ids), k), dtype=np.int64)
        self.best_ids = np.zeros((len(ids), k), dtype=np.int64)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query ids, ids and scores."""
        filled = np.arange(self.k) < self.count[:, None]
        return np.repeat(self.ids, self.count), self.best_ids[filled], self.best_scores[filled]

    def _take(self, asked: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge the scores (queries x rows) that reach what is wanted."""
        least = self.worst[asked]
        if scores.dtype == np.float32:  # scores are below 2^24, so rounding decides nothing
            least = least.astype(np.float32)
        some = np.flatnonzero(scores.max(axis=1) >= least)
        if len(some) == 0:
            return
        row, column = np.nonzero(scores[some] >= least[some, None])
        row = some[row]
        other = ids[column] != self.ids[asked[row]]
        row, column = row[other], column[other]
        if len(row) == 0:
            return
        values, names = scores[row, column].astype(np.int64), ids[column]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(row)], strict=True):
            q = asked[row[at]]
            held = self.count[q]
            merged = np.concatenate([self.best_scores[q, :held], values[at:end]])
            named = np.concatenate([self.best_ids[q, :held], names[at:end]])
            order = np.lexsort((named, ~merged))[: self.k]
            held = self.count[q] = len(order)
            self.best_scores[q, :held], self.best_ids[q, :held] = merged[order], named[order]
            if held == self.k:
                self.worst[q] = max(self.worst[q], _at_most(merged[order[-1]]))

    def search(self, tree: MTree) -> None:
        """Best-first search of one more tree."""
        real, norms, worst = self.rows.astype(np.float64), self.norms, self.worst
        # No partial sum exceeds the product of the norms.
        most = float(norms.max(initial=0.0)) * tree.norm
        exact = most < 2**52
        if most < 2**24 - 1:
            left, right = self.rows.astype(np.float32), tree.singles
        elif exact:
            left, right = real, tree.doubles
        else:
            left, right = self.rows, tree.rows
        slack = 1e-9 * (norms * tree.reach + 1)
        per = np.maximum(norms, 1e-300)

        def open_leaves(leaves: list[tuple[int, np.ndarray, np.ndarray]]) -> int:
            """Takes the products of leaves; how many these were."""
            kept = []
            for node, some, to_node in leaves:
                # Stored distances to the routing vector rule out entries without a product.
                gain = ((worst[some] - to_node - slack[some]) / per[some]).min()
                first, last = tree.first[node], tree.last[node]
                keep = np.flatnonzero(tree.own[first:last] >= gain) + first
                if len(keep):
                    kept.append((some, keep))
            if not kept:
                return 0
            any_of = np.zeros(len(norms), dtype=bool)
            for some, _ in kept:
                any_of[some] = True
            asked, rows = np.flatnonzero(any_of), np.concatenate([keep for _, keep in kept])
            apart = sum(len(some) * len(keep) for some, keep in kept)
            together = len(asked) * len(rows)
            for some, keep in [(asked, rows)] if together < 2 * apart else kept:
                self._take(some, _products(left[some], right[keep], exact), tree.ids[keep])
            return apart

        everyone = np.arange(len(norms))
        to_root = real @ tree.route[0]
        bounds = to_root + norms * tree.radius[0] + slack
        heap = [(-float(bounds.max(initial=-np.inf)), 0, everyone, to_root, bounds)]
        # Leaves are opened one by one at first, since the best raise what the others must
        # reach, then ever more at a time.
        leaves, waiting, limit = [], 0, 1
        while heap:
            _, node, some, to_node, bounds = heapq.heappop(heap)
            some, to_node = _where(bounds >= worst[some], some, to_node)
            if len(some):
                low, high = tree.kids[node]
                if high > low:
                    self._open(tree, (low, high), real, slack, some, to_node, heap)
                else:
                    leaves.append((node, some, to_node))
                    waiting += len(some) * int(tree.last[node] - tree.first[node])
            if leaves and (waiting >= limit or not heap):
                limit = min(max(limit, 2 * open_leaves(leaves)), _PRODUCTS)
                leaves, waiting = [], 0

    def _open(
        self,
        tree: MTree,
        kids: tuple[int, int],
        real: np.ndarray,
        slack: np.ndarray,
        some: np.ndarray,
        to_node: np.ndarray,
        heap: list,
    ) -> None:
        """Push the children that some query can gain from."""
        low, high = kids
        norms, slack, worst = self.norms[some], slack[some], self.worst[some]
        far = (tree.parent[low:high] + tree.radius[low:high])[:, None]
        can = to_node + norms * far + slack >= worst
        near = np.flatnonzero(can.any(axis=1))
        if len(near) == 0:
            return
        can, near = can[near], near + low
        to = tree.route[near] @ real[some].T
        reach = to + norms * tree.radius[near, None] + slack
        can &= reach >= worst
        for j in np.flatnonzero(can.any(axis=1)).tolist():
            mine, to_child, bounds = _where(can[j], some, to[j], reach[j])
            heapq.heappush(heap, (-float(bounds.max()), int(near[j]), mine, to_child, bounds))


def search_tree(
    tree: MTree,
    queries: np.ndarray,
    query_ids: np.ndarray,
    k: int,
    floors: np.ndarray | None = None,
) -> list[tuple[int, int, int]]:
    """(query_id, id, score) of the k best rows of the tree for each query, without its own row.

    Of a query with a floor, only rows that reach it are wanted.
    """
    asked = Asked(queries, query_ids, k, floors)
    asked.search(tree)
    return list(zip(*(x.tolist() for x in asked.found()), strict=True))


def integer_rows(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """(id, floor(scale * x)) of rows that take part."""
    for ident, vector in zip(batch["id"].to_pylist(), batch["vector"].to_pylist(), strict=True):
        if ident is None or vector is None or any(x is None for x in vector):
            continue
        floored = np.floor(np.array(vector, dtype=np.float64) * scale)
        if np.isfinite(floored).all():
            yield ident, floored


def _chunked(rows: Iterator[tuple[int, np.ndarray]], size: int):
    """(dim, ids, vectors) of at most `size` rows of one dimension."""
    held: dict[int, tuple[list, list]] = {}
    for ident, vector in rows:
        ids, vectors = held.setdefault(len(vector), ([], []))
        ids.append(ident)
        vectors.append(vector)
        if len(ids) == size:
            del held[len(vector)]
            yield len(vector), np.array(ids, dtype=np.int64), np.stack(vectors)
    for dim, (ids, vectors) in held.items():
        yield dim, np.array(ids, dtype=np.int64), np.stack(vectors)


def _packed(x: np.ndarray) -> bytes:
    """Integral doubles, as 16-bit integers where they fit."""
    small = x.size == 0 or float(np.abs(x).max()) < 32_000
    return (b"s" + x.astype("<i2").tobytes()) if small else (b"d" + x.astype("<f8").tobytes())


def _unpacked(raw: bytes | memoryview, dim: int) -> np.ndarray:
    values = np.frombuffer(raw, dtype="<i2" if bytes(raw[:1]) == b"s" else "<f8", offset=1)
    return values.reshape(-1, dim) if dim else values.reshape(0, 0)


_PARTS = ("own", "route", "radius", "parent", "kids", "first", "last")


def index_blocks(
    vectors: DataFrame, scale: int = 1024, block_rows: int = 8192, page: int = 64
) -> DataFrame:
    """The index: block, dim, ids, rows and the node arrays of one M-tree per row.

    `vectors` has id and vector. Blocks are cut along the input splits, nothing is shuffled.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId() << 32, 0
        rows = (r for batch in batches for r in integer_rows(batch, scale))
        for dim, ids, values in _chunked(rows, block_rows):
            if dim == 0:
                continue
            tree = build_tree(ids, values, page)
            out = {"block": [part + made], "dim": [dim], "ids": [tree.ids.tobytes()],
                   "rows": [_packed(tree.rows)]}
            out |= {name: [np.ascontiguousarray(getattr(tree, name)).tobytes()] for name in _PARTS}
            made += 1
            kinds = [pa.int64(), pa.int32()] + [pa.binary()] * (2 + len(_PARTS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out)
            )

    schema = "block bigint, dim int, ids binary, rows binary, " + ", ".join(
        f"{name} binary" for name in _PARTS
    )
    return vectors.select("id", "vector").mapInArrow(build, schema)


def _tree(row: dict) -> MTree:
    dim = row["dim"]
    return MTree(
        _unpacked(row["rows"], dim),
        np.frombuffer(row["ids"], dtype=np.int64),
        np.frombuffer(row["own"], dtype=np.float64),
        np.frombuffer(row["route"], dtype=np.float64).reshape(-1, dim),
        np.frombuffer(row["radius"], dtype=np.float64),
        np.frombuffer(row["parent"], dtype=np.float64),
        np.frombuffer(row["kids"], dtype=np.int64).reshape(-1, 2),
        np.frombuffer(row["first"], dtype=np.int64),
        np.frombuffer(row["last"], dtype=np.int64),
    )


def query_blocks(queries: DataFrame, scale: int = 1024, size: int = 512) -> DataFrame:
    """query_dim, query_ids, query_rows, query_floors: at most `size` queries a row.

    `queries` has id, vector and floor, the score a row must reach; null for any.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, int] = {}

        def rows() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                for ident, floor in zip(batch["id"].to_pylist(), batch["floor"].to_pylist(), strict=True):
                    floors[ident] = _LOW if floor is None else floor
                yield from integer_rows(batch, scale)

        for dim, ids, values in _chunked(rows(), size):
            least = np.array([floors.pop(i, _LOW) for i in ids.tolist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                 pa.array([_packed(values)], pa.binary()), pa.array([least.tobytes()], pa.binary())],
                ["query_dim", "query_ids", "query_rows", "query_floors"],
            )

    return queries.select("id", "vector", "floor").mapInArrow(
        pack, "query_dim int, query_ids binary, query_rows binary, query_floors binary"
    )


def dealt(
    trees: int, tree_bytes: int, blocks: int, asked_bytes: int, held: int, tasks: int, cores: int
) -> tuple[int, int]:
    """(lanes, groups): into how many lanes trees go and into how many groups blocks of queries.

    Every tree goes to each group, every block to each lane. A task holds the queries of a
    group, `held` bytes for all of them. There are at most `tasks` tasks, and, beyond three a
    core, no more than let the copies of the queries weigh as much as the trees.
    """
    share = max(1, tree_bytes) / max(1, asked_bytes)
    tasks = max(1, min(tasks, max(3 * cores, math.ceil(share))))
    spread = max(math.ceil(math.sqrt(tasks / share)), -(-tasks // max(1, trees)))
    groups = max(1, min(blocks, max(-(-held // _HELD), spread)))
    return max(1, min(trees, -(-tasks // groups))), groups


def _found(index: DataFrame, blocks: DataFrame, k: int, lanes: int, groups: int) -> DataFrame:
    """query_id, vec_id, score: per query and lane its k best rows that reach its floor."""
    key = ("dim", "lane", "grp")
    trees = index.select(
        "*",
        F.lit(None).cast("binary").alias("floors"),
        F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"),
    )
    asked = blocks.where("query_dim > 0").select(
        F.lit(None).cast("bigint").alias("block"),
        F.col("query_dim").alias("dim"),
        F.col("query_ids").alias("ids"),
        F.col("query_rows").alias("rows"),
        *(F.lit(None).cast("binary").alias(name) for name in _PARTS),
        F.col("query_floors").alias("floors"),
        F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"),
        F.pmod(F.xxhash64("query_ids"), F.lit(groups)).cast("int").alias("grp"),
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            for asked in held:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in asked.found()], ["query_id", "vec_id", "score"]
                )

        for batch in batches:
            keys = zip(*(batch[c].to_pylist() for c in key), batch["block"].to_pylist(), strict=True)
            for i, (*now, block) in enumerate(keys):
                if now != current:
                    yield from found()
                    current, held = now, []
                if block is None:
                    parts = [memoryview(batch[c][i].as_buffer()) for c in ("rows", "ids", "floors")]
                    rows = _unpacked(parts[0], now[0]).copy()
                    ids, floors = (np.frombuffer(x, dtype=np.int64).copy() for x in parts[1:])
                    held.append(Asked(rows, ids, k, floors))
                elif held:
                    raw = {c: memoryview(batch[c][i].as_buffer()) for c in ("rows", "ids", *_PARTS)}
                    tree = _tree(raw | {"dim": now[0]})
                    for asked in held:
                        asked.search(tree)
        yield from found()

    # Blocks of queries, without a tree, come first within a key.
    together = (
        trees.unionByName(asked)
        .repartition(2 * lanes * groups, *key)
        .sortWithinPartitions(*key, F.asc_nulls_first("block"))
    )
    return together.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")


def rounds_of(trees: int, first: int = 1) -> list[tuple[float, float]]:
    """Shares of the trees searched in each round: `first` of them, then four times as many as
    before in all."""
    ends = []
    end = first
    while end < trees:
        ends.append(end / trees)
        end *= 5
    ends.append(1.0)
    return list(zip([0.0, *ends[:-1]], ends, strict=True))


def top_k(
    index: DataFrame,
    queries: DataFrame,
    k: int = 10,
    lanes: int | None = None,
    scale: int = 1024,
    size: int = 512,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of the index for every query.

    `index` is a stored `index_blocks`, `queries` has unique id and vector. A query's own row,
    known by its id, is left out; vectors of another length are no candidates. Ties go to the
    smaller id. Fewer than k candidates give fewer rows, an empty table on either side none.
    """
    spark = index.sparkSession
    cores = spark.sparkContext.defaultParallelism
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores)
    asked = stored_once(queries.select("id", "vector"), "mtree-asked")
    count = asked.count()
    # Several blocks a task, so that few are left half full.
    packing = max(1, -(-count // (8 * size)))
    trees, tree_bytes = index.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.length("rows")), F.lit(0))
    ).first()
    best = None
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    place = F.pmod(F.xxhash64("block", F.lit("round")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    for low, high in rounds_of(trees):
        if best is None:
            known = asked.withColumn("floor", F.lit(None).cast("bigint"))
        else:
            floors = best.where(F.col("rank") == k).select(
                F.col("query_id").alias("_id"), F.col("score").alias("floor")
            )
            known = asked.join(floors, F.col("id") == F.col("_id"), "left")
        blocks = stored_once(
            query_blocks(known.repartition(packing, "id"), scale, size), "mtree-queries"
        )
        some, asked_bytes = blocks.agg(
            F.count(F.lit(1)), F.coalesce(F.sum(F.length("query_rows")), F.lit(0))
        ).first()
        held = asked_bytes + count * (16 * k + 64)
        now = math.ceil(trees * (high - low)), math.ceil(tree_bytes * (high - low))
        across, groups = dealt(*now, some, asked_bytes, held, tasks, cores)
        found = _found(
            index.where((place >= low) & (place < high)), blocks, k, lanes or across, groups
        )
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = stored_once(
            found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k),
            "mtree-best",
        )
    return best.select("query_id", "rank", "vec_id", "score")


def search(
    embeddings: DataFrame,
    k: int = 10,
    every: int = 100,
    ident: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    block_rows: int = 8192,
) -> DataFrame:
    """Top k of all rows for the queries whose id is divisible by `every`.

    Components x become floor(scale * x) in double precision. Rows with a null id or vector,
    or with null or non-finite components (also after scaling), take no part. Scores
    beyond 64 bits are cut to the nearest 64-bit number.
    """
    given = embeddings.select(F.col(ident).cast("bigint").alias("id"), F.col(vector).alias("vector"))
    index = stored_once(index_blocks(given, scale, block_rows), "mtree-index")
    return top_k(index, given.where(F.pmod("id", F.lit(every)) == 0), k, scale=scale)
