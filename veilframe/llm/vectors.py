"""Near-duplicate vectors by collision-counting projections, links verified by cosine.

Unit vectors u, v differ on a Gaussian projection by a normal amount of variance |u - v|^2,
so near pairs fall into one another's window on most projections and far pairs on few.
Windows over a whole table would hold a fixed share of all rows; they are therefore
searched within cells. Each of `tables` tables deals the vectors into 2^bits cells by the
signs of `bits` projections of its own. In a cell, each of `projections` shared projections is
sorted, every vector's window is found on it, and collisions are counted per pair. Pairs
with at least `least` collisions are verified by cosine in double precision.

All numbers follow from the number of vectors and the wanted recall at the threshold: bits so
that a cell holds about `cell_rows` vectors, tables so that a pair at the threshold shares a
cell but for `miss`, and `least` so that it passes the count but for half of `miss`.

Equal vectors are one node with a multiplicity. A pair is counted in the first table in
which it shares a cell, so tasks return sums of links and a spanning set of them, not
pairs. Cells over `block` rows are compared block against block.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import stored_once
from veilframe.llm.components import components


@dataclass(frozen=True)
class Plan:
    bits: int
    tables: int
    projections: int
    window: float
    least: int


def plan_for(
    vectors: int,
    similarity: float,
    miss: float = 0.002,
    cell_rows: int = 128,
    projections: int = 32,
    width: float = 1.35,
) -> Plan:
    """Cells and counts for so many vectors; `width` is the window in deviations of a pair."""
    if not -1 < similarity < 1:
        raise ValueError("similarity must lie between -1 and 1")
    bits = min(30, max(0, math.ceil(math.log2(max(1, vectors) / cell_rows))))
    together = (1 - math.acos(similarity) / math.pi) ** bits
    tables = 1 if bits == 0 else math.ceil(math.log(miss) / math.log1p(-together))
    hit = math.erf(width / math.sqrt(2))
    below, least = 0.0, 0
    while least < projections:
        below += math.comb(projections, least) * hit**least * (1 - hit) ** (projections - least)
        if below > miss / 2:
            break
        least += 1
    return Plan(bits, tables, projections, width * math.sqrt(2 - 2 * similarity), least)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, without null or non-finite components, not zero."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
    )
    return F.coalesce(
        vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def _unit(rows: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


@functools.lru_cache(maxsize=8)
def _gaussians(seed: int, dim: int, count: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def with_cells(nodes: DataFrame, plan: Plan, seed: int) -> DataFrame:
    """node, copies, dim, vector (doubles), cells (a number per table)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(plan.bits, dtype=np.int64)
        for batch in batches:
            vectors = [np.array(v, dtype=np.float64) for v in batch["vector"].to_pylist()]
            cells = []
            for v in vectors:
                signs = _unit(v[None, :])[0] @ _gaussians(seed, len(v), plan.bits * plan.tables) > 0
                numbers = signs.reshape(plan.tables, plan.bits) @ weights
                cells.append(numbers.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch["node"], batch["copies"], pa.array([len(v) for v in vectors], pa.int32()),
                 pa.array([v.tobytes() for v in vectors], pa.binary()),
                 pa.array(cells, pa.list_(pa.int32()))],
                ["node", "copies", "dim", "vector", "cells"],
            )

    return nodes.select("node", "copies", "vector").mapInArrow(
        rows, "node bigint, copies bigint, dim int, vector binary, cells array<int>"
    )


def collisions(values: np.ndarray, window: float) -> np.ndarray:
    """Rows x rows: on how many projections (columns) each row lies in another's window."""
    n = len(values)
    counts = np.zeros((n, n), dtype=np.int16)
    rank = np.empty(n, dtype=np.int32)
    for column in values.T:
        order = np.argsort(column, kind="stable")
        ordered = column[order]
        rank[order] = np.arange(n, dtype=np.int32)
        low = np.searchsorted(ordered, column - window, "left").astype(np.int32)
        high = np.searchsorted(ordered, column + window, "right").astype(np.int32)
        counts += (rank[None, :] >= low[:, None]) & (rank[None, :] < high[:, None])
    return counts


def cell_links(
    table: int,
    nodes: np.ndarray,
    sides: np.ndarray,
    copies: np.ndarray,
    vectors: np.ndarray,
    cells: np.ndarray,
    plan: Plan,
    seed: int,
    similarity: float,
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links added per row, spanning links) among the rows of one cell of one table.

    Only pairs that share no cell in an earlier table count. With two sides only pairs
    across them are compared.
    """
    units = _unit(vectors)
    counts = collisions(units @ _gaussians(seed + 1, vectors.shape[1], plan.projections), plan.window)
    wanted = np.triu(counts >= plan.least, 1)
    if len(np.unique(sides)) > 1:
        wanted &= sides[:, None] != sides[None, :]
    i, j = np.nonzero(wanted)
    added = np.zeros(len(nodes), dtype=np.int64)
    if len(i) == 0:
        return added, []
    good = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 100_000):  # bounds what is held at a time
        a, b = i[at : at + 100_000], j[at : at + 100_000]
        close = (units[a] * units[b]).sum(axis=1) >= similarity
        close[close] = ~(cells[a[close], :table] == cells[b[close], :table]).any(axis=1)
        good[at : at + 100_000] = close
    i, j = i[good], j[good]
    np.add.at(added, i, copies[j])
    np.add.at(added, j, copies[i])
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    spanning = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            spanning.append((int(nodes[a]), int(nodes[b])))
    return added, spanning


def _linked(rows: DataFrame, plan: Plan, seed: int, similarity: float) -> DataFrame:
    """(a, b, n): n links of node a where b is null, else a spanning link of a and b."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(key: tuple, held: list[tuple]) -> pa.RecordBatch | None:
            node, side, copies, vector, cells = zip(*held, strict=True)
            nodes = np.array(node, dtype=np.int64)
            added, spanning = cell_links(
                key[0],
                nodes,
                np.array(side),
                np.array(copies, dtype=np.int64),
                np.stack([np.frombuffer(v, dtype=np.float64) for v in vector]),
                np.array(cells, dtype=np.int32),
                plan,
                seed,
                similarity,
            )
            some = np.flatnonzero(added)
            if len(some) == 0:
                return None
            a = [*nodes[some].tolist(), *(x for x, _ in spanning)]
            b = [*[None] * len(some), *(y for _, y in spanning)]
            n = [*added[some].tolist(), *[0] * len(spanning)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)], schema=schema)

        current, held = None, []
        for batch in batches:
            names = ("table", "dim", "cell", "x", "y", "node", "side", "copies", "vector", "cells")
            columns = [batch[c].to_pylist() for c in names]
            for row in zip(*columns, strict=True):
                key = row[:5]
                if key != current:
                    if len(held) > 1 and (out := found(current, held)) is not None:
                        yield out
                    current, held = key, []
                held.append(row[5:])
        if len(held) > 1 and (out := found(current, held)) is not None:
            yield out

    return rows.mapInArrow(stream, "a bigint, b bigint, n bigint")


def near_vectors(
    embeddings: DataFrame,
    ident: str = "vec_id",
    vector: str = "embedding",
    similarity: float = 0.9,
    seed: int = 11,
    block: int = 1024,
    miss: float = 0.002,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, zero, or hold null or non-finite components link with nothing,
    nor do rows with a null id (component_id null, kept true). Vectors of different lengths
    never link. Equal rows are vectors of their own, linked with each other. An empty table
    gives no rows. Other columns are not read.
    """
    given = embeddings.select(
        F.col(ident).cast("bigint").alias("id"), F.col(vector).alias("vector")
    ).withColumn("ok", usable(F.col("vector")) & F.col("id").isNotNull())
    usable_rows = given.where("ok").select("id", F.col("vector").cast("array<double>").alias("vector"))
    nodes = stored_once(
        usable_rows.groupBy("vector").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")),
        "vector-nodes",
    )
    plan = plan_for(nodes.count(), similarity, miss)
    celled = stored_once(with_cells(nodes, plan, seed), "vector-cells")

    rows = celled.select("node", "dim", F.posexplode("cells").alias("table", "cell"))
    sizes = rows.groupBy("table", "dim", "cell").agg(F.count(F.lit(1)).alias("size"))
    parts = F.ceil(F.col("size") / F.lit(block)).cast("int")
    placed = (
        rows.join(sizes.where("size > 1"), ["table", "dim", "cell"])
        .withColumn("parts", parts)
        .withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("x", F.least("side", "other"))
        .withColumn("y", F.greatest("side", "other"))
        .drop("size", "parts", "other", "dim")
        .join(celled, "node")
        .repartition("table", "dim", "cell", "x", "y")
        .sortWithinPartitions("table", "dim", "cell", "x", "y", "node")
    )
    found = stored_once(_linked(placed, plan, seed, similarity), "vector-links")
    sums = found.where("b is null").groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("_n"))
    merged = components(found.where("b is not null"))
    answers = (
        nodes.join(sums, F.col("node") == F.col("_a"), "left")
        .join(merged, F.col("node") == F.col("id"), "left")
        .select(
            F.col("vector").alias("_vector"),
            (F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    linked = usable_rows.join(answers, F.col("vector") == F.col("_vector")).select(
        F.col("id").alias("vec_id"), "n_links", "component_id"
    )
    others = given.where(~F.col("ok")).select(
        F.col("id").alias("vec_id"),
        F.lit(0).cast("bigint").alias("n_links"),
        F.col("id").alias("component_id"),
    )
    return linked.union(others).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
