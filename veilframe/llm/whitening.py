"""Embedding whitening by blockwise QR and a bidiagonal qd solver.

The rows, centred exactly in whole numbers, are reduced to one triangular matrix R: each task
folds its rows into a triangle block by block, triangles are merged sixteen at a time until few are
left, and R'R is then the scatter matrix without ever being formed. R has the size of a
vector squared, whatever the number of rows. Householder reflections turn R into an upper
bidiagonal matrix; the differential qd algorithm with shifts (dqds) finds its singular values;
a twisted factorisation at each of them gives the singular vector, which the reflections carry
back to a direction. Close values are told apart by iterating with orthogonalisation.

Rows are then projected on the directions and divided by their deviations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import stored_once

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
_EPS = float(np.finfo(float).eps)
# Directions along which rows deviate less than this share of the most are rounding errors.
_LEAST_SHARE = 1e-11
# Values closer than this, relative to their size, are iterated with orthogonalisation.
_CLOSE = 1e-3
_BLOCK_ROWS = 2048
_FAN = 16
_ZERO_SWEEPS = 20
# Entries from here on have no place in a long after scaling.
_LARGEST = float(1 << 52)


def _whole(vector: Column) -> Column:
    """floor(1024 c) + 100000 of each entry, as longs; null for a vector that takes no part."""
    finite = F.forall(
        vector,
        lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(_LARGEST)),
    )
    whole = F.transform(
        vector,
        lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("bigint") + F.lit(SHIFT),
    )
    return F.when(F.coalesce(vector.isNotNull() & finite & (F.size(vector) > 0), F.lit(False)), whole)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """How many rows there are, and their sum in each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _matrix(batch["x"])
            largest = max(abs(int(x.max())), abs(int(x.min())))
            part = (x if largest * len(x) < 1 << 62 else x.astype(object)).sum(axis=0).astype(object)
            n, total = n + batch.num_rows, part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(total)), pa.int32()),
                 pa.array([Decimal(n), *map(Decimal, total)], pa.decimal128(38, 0))],
                ["dimension", "total"],
            )

    parts = rows.select("x").mapInArrow(add, "dimension int, total decimal(38,0)")
    found = parts.groupBy("dimension").agg(F.sum("total").alias("total")).orderBy("dimension").toArrow()
    values = [int(v) for v in found["total"].to_pylist()]
    return (values[0], values[1:]) if values else (0, [])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows x dimensions of a list column without nulls, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly: as 64-bit integers where they hold it, else as Python's."""
    largest = max(abs(int(x.max())), abs(int(x.min()))) * n + max(abs(int(s)) for s in sums)
    if largest < 1 << 62:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def folded(triangle: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangle of QR over the rows of a triangle and more rows."""
    stacked = rows if triangle is None else np.vstack([triangle, rows])
    return np.linalg.qr(stacked, mode="r")


def triangle_of(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R with R'R the scatter matrix of the centred rows."""
    size, total = len(sums), np.array(sums, dtype=object)

    def packed(triangle: np.ndarray) -> bytes:
        full = np.zeros((size, size))
        full[: len(triangle)] = triangle
        return full.tobytes()

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = None
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK_ROWS):
                x = _matrix(batch["x"].slice(at, _BLOCK_ROWS))
                triangle = folded(triangle, _centred(x, n, total).astype(float) / n)
        if triangle is not None:
            yield pa.RecordBatch.from_arrays([pa.array([packed(triangle)], pa.binary())], ["r"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = None
        for batch in batches:
            for r in batch["r"]:
                triangle = folded(triangle, np.frombuffer(r.as_py()).reshape(size, size))
        if triangle is not None:
            yield pa.RecordBatch.from_arrays([pa.array([packed(triangle)], pa.binary())], ["r"])

    parts = rows.select("x").mapInArrow(reduce_rows, "r binary")
    found = stored_once(parts, "whitening-triangles")
    left = found.count()
    while left > _FAN:
        left = -(-left // _FAN)
        merged = found.repartition(left).mapInArrow(merge, "r binary")
        found = stored_once(merged, "whitening-triangles")
    triangle = None
    for r in found.toArrow()["r"].to_pylist():
        triangle = folded(triangle, np.frombuffer(r).reshape(size, size))
    return triangle


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(diagonal, superdiagonal, reflections from the right) of a square matrix."""
    a = np.array(r, dtype=float)
    n = len(a)
    right = []

    def reflector(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if norm == 0 or not x[1:].any():
            return None
        v = x / norm
        v[0] += math.copysign(1.0, v[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(a[k:, k].copy())
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            w = reflector(a[k, k + 1 :].copy())
            if w is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
                right.append((k + 1, w))
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling.

    A sweep takes q, e of B'B - s to those of a similar matrix; the shift s stays below the
    smallest value, or the sweep is undone and repeated with a smaller one. Values appear at
    the end as e dies out, each a sum of positive shifts, and so to high relative accuracy.
    """
    blocks = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    out = []
    while blocks:
        q, e, shifted = blocks.pop()
        sweeps = 0
        while q:
            if len(q) == 1:
                out.append(shifted + q.pop())
                continue
            cut = next(
                (k for k in reversed(range(len(e))) if e[k] <= _EPS**2 * (shifted + min(q[k], q[k + 1]))),
                None,
            )
            if cut is not None:
                blocks.append((q[cut + 1 :], e[cut + 1 :], shifted))
                q, e, sweeps = q[: cut + 1], e[:cut], 0
                continue
            if q[0] * 1.5 < q[-1]:  # small values belong to the end
                q.reverse()
                e.reverse()
            sweeps += 1
            shift = 0.0 if sweeps % _ZERO_SWEEPS == 0 else _shift(q, e)
            while (swept := _sweep(q, e, shift)) is None:
                shift = shift / 4 if shift > 1e-300 + _EPS * q[-1] else 0.0
            q, e = swept
            shifted += shift
    return np.sort(np.array(out))[::-1]


def _shift(q: list[float], e: list[float]) -> float:
    """Just below the smaller value of the last two rows."""
    a, b = q[-2] + (e[-3] if len(e) > 2 else 0.0), q[-1] + e[-1]
    product = q[-2] * e[-1]
    half = (a - b) / 2
    low = b - product / (half + math.copysign(math.hypot(half, math.sqrt(product)), half or 1.0))
    low = min(low, a + b - low)
    return max(0.0, low * (1 - 1e-3) - math.sqrt(e[-1] * _EPS))


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """The next q, e; none if the shift was too large."""
    next_q, next_e = [], []
    d = q[0] - shift
    for k, off in enumerate(e):
        if d < 0 or (d == 0 and off == 0):
            return None
        total = d + off
        next_q.append(total)
        next_e.append(off * (q[k + 1] / total))
        d = d * (q[k + 1] / total) - shift
    if d < 0 or not math.isfinite(d):
        return None
    next_q.append(d)
    return next_q, next_e


def _twisted(
    d: np.ndarray, low: np.ndarray, value: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Factors of L D L' - value from both ends, and the pivot left at every twist.

    (pivots and multipliers from the top, the same from the bottom, remaining pivots).
    """
    n = len(d)
    tiny = _EPS * _EPS * (abs(value) + float(np.max(np.abs(d))))

    def safe(x: float) -> float:
        return x if abs(x) > tiny else math.copysign(tiny, x)

    top, down = np.empty(n), np.empty(n - 1)
    s = np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        top[i] = safe(d[i] + s[i])
        down[i] = d[i] * low[i] / top[i]
        s[i + 1] = down[i] * low[i] * s[i] - value
    top[n - 1] = safe(d[n - 1] + s[n - 1])
    bottom, up = np.empty(n), np.empty(n - 1)
    p = np.empty(n)
    p[n - 1] = safe(d[n - 1] - value)
    for i in range(n - 2, -1, -1):
        bottom[i + 1] = safe(d[i] * low[i] * low[i] + p[i + 1])
        ratio = d[i] / bottom[i + 1]
        up[i] = low[i] * ratio
        p[i] = safe(p[i + 1] * ratio - value)
    bottom[0] = p[0]
    return top, down, bottom, up, s + p + value


def _solved(parts: tuple, right: np.ndarray, twist: int) -> np.ndarray:
    """x with (L D L' - value) x = right, through the factors that meet at `twist`."""
    top, down, bottom, up, pivots = parts
    n = len(right)
    y = right.astype(float).copy()
    for i in range(twist):
        y[i + 1] -= down[i] * y[i]
    for i in range(n - 1, twist, -1):
        y[i - 1] -= up[i - 1] * y[i]
    pivot = pivots[twist] or _EPS * _EPS * float(np.max(np.abs(top)))
    x = np.empty(n)
    x[twist] = y[twist] / pivot
    for i in range(twist - 1, -1, -1):
        x[i] = y[i] / top[i] - down[i] * x[i + 1]
    for i in range(twist + 1, n):
        x[i] = y[i] / bottom[i] - up[i - 1] * x[i - 1]
    return x


def _vector(parts: tuple, twist: int) -> np.ndarray:
    """The vector that the factors meeting at `twist` send to a multiple of one unit vector."""
    _, down, _, up, pivots = parts
    z = np.zeros(len(pivots))
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(twist, len(pivots) - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right singular vectors (columns) of an upper bidiagonal matrix.

    `values` are its largest squared singular values, falling.
    """
    n = len(diagonal)
    largest = float(values[0])
    # A zero on the diagonal moves by a rounding error of the largest value.
    a = np.where(np.abs(diagonal) < _EPS * math.sqrt(largest), _EPS * math.sqrt(largest), diagonal)
    off = np.where(np.abs(above) < _EPS * 1e-3 * math.sqrt(largest), 0.0, above)
    d, low = a * a, off / a[:-1]
    out = np.empty((n, len(values)))
    rng = np.random.default_rng(17)
    near: list[int] = []
    for k, value in enumerate(values.tolist()):
        if near and values[near[-1]] - value > _CLOSE * values[near[-1]]:
            near = []
        parts = _twisted(d, low, value)
        twist = int(np.argmin(np.abs(parts[4])))
        z = _vector(parts, twist)
        if near:
            earlier = out[:, near]
            z -= earlier @ (earlier.T @ z)
            if np.linalg.norm(z) < 0.1:
                z = rng.standard_normal(n)
            for _ in range(4):
                z -= earlier @ (earlier.T @ z)
                z = _solved(parts, z / np.linalg.norm(z), twist)
                z /= np.linalg.norm(z)
                z -= earlier @ (earlier.T @ z)
                z -= earlier @ (earlier.T @ z)
                z /= np.linalg.norm(z)
        out[:, k] = z
        near.append(k)
    return out


def principal(triangle: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(largest squared singular values, falling; their right vectors as columns).

    Values that are rounding errors of the largest one are left out.
    """
    scale = float(np.abs(triangle).max()) if triangle.size else 0.0
    if scale == 0:
        return np.zeros(0), np.zeros((len(triangle), 0))
    diagonal, above, right = bidiagonal(triangle / scale)
    values = dqds(diagonal, above)
    kept = min(components, int((values > values[0] * _LEAST_SHARE**2).sum()))
    known = right_vectors(diagonal, above, values[:kept])
    for at, w in reversed(right):
        known[at:] -= 2 * np.outer(w, w @ known[at:])
    return values[:kept] * scale**2, known


def whiten(
    embeddings: DataFrame,
    ident: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    One row for each vector that takes part and component, numbered from 1 by falling variance.
    Vectors take no part that are null, empty, hold null or non-finite entries or entries of 2^52
    and over, or differ in length from most (the longer length, where two are as frequent). Null
    ids are kept, repeated rows count and are answered each. Directions without variance are no
    components, so equal vectors, one vector or none give no rows. Other columns are not read.
    """
    given = embeddings.select(F.col(ident).alias("vec_id"), _whole(F.col(vector)).alias("x")).where(
        "x is not null"
    )
    sizes = given.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size = most[0]["size"] if most else 0
    rows = given.where(F.size("x") == size)
    kind = rows.schema["vec_id"].dataType.simpleString()
    n, sums = _sums(rows)
    values, directions = np.zeros(0), np.zeros((size, 0))
    trace = 1.0
    if n:
        triangle = triangle_of(rows, n, sums)
        values, directions = principal(triangle, components)
        trace = float((triangle * triangle).sum()) / n
    variances = values / n if n else values
    loadings = directions / np.sqrt(variances) if len(variances) else directions
    total = np.array(sums, dtype=object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0 or loadings.shape[1] == 0:
                continue
            y = _centred(_matrix(batch["x"]), n, total)
            if y.dtype != object and int(np.abs(y).max()) ** 2 * size < 1 << 62:
                deviation = (y * y).sum(axis=1).tolist()
            else:
                deviation = (y.astype(object) ** 2).sum(axis=1).tolist()
            # Row by row, so that a row's figures do not hang on its batch.
            whitened = [(row[:, None] * loadings).sum(axis=0) for row in y.astype(float) / n]
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"],
                 pa.array([Decimal(v) for v in deviation], pa.decimal128(38, 0)),
                 pa.array([w.tolist() for w in whitened], pa.list_(pa.float64()))],
                ["vec_id", "deviation", "w"],
            )

    projected = stored_once(
        rows.mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), w array<double>"),
        "whitening-rows",
    )
    error = _identity_error(projected, len(variances))
    # The last digits of these literals are kept: they are doubles, not decimals.
    explained = F.array(*[F.lit(float(v / trace)) for v in variances]) if len(variances) else F.array()
    return (
        projected.select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened"))
        .withColumn("component", (F.col("place") + 1).cast("int"))
        .select(
            "vec_id",
            "component",
            F.lit(n).cast("bigint").alias("n"),
            "deviation",
            "whitened",
            F.get(explained, F.col("place")).cast("double").alias("explained"),
            F.lit(error).cast("double").alias("identity_error"),
        )
    )


def _identity_error(projected: DataFrame, components: int) -> float:
    """The largest entry by which the covariance of the whitened rows misses the identity."""
    if components == 0:
        return 0.0
    axes = range(components)
    means = projected.agg(*[F.avg(F.get("w", F.lit(i))).alias(f"m{i}") for i in axes]).first()
    centred = [F.get("w", F.lit(i)) - F.lit(float(means[i])) for i in axes]
    found = projected.agg(
        *[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i in axes for j in range(i + 1)]
    ).first()
    return max(
        abs(found[f"c{i}_{j}"] - (1.0 if i == j else 0.0)) for i in axes for j in range(i + 1)
    )
