"""The singular value solver against numpy's, and whitened rows against an eigensolver."""

import numpy as np
import pytest

from veilframe.llm import whitening as wh


def with_values(values, seed):
    rng = np.random.default_rng(seed)
    n = len(values)
    left, _ = np.linalg.qr(rng.standard_normal((n, n)))
    right, _ = np.linalg.qr(rng.standard_normal((n, n)))
    return np.linalg.qr(left @ np.diag(values) @ right, mode="r")


CASES = {
    "random": np.triu(np.random.default_rng(1).standard_normal((64, 64))),
    "wide": np.triu(np.random.default_rng(2).standard_normal((200, 200))),
    "one": np.array([[-3.0]]),
    "two": np.array([[1.0, 2.0], [0.0, 1e-8]]),
    "identity": np.eye(10),
    "repeated on the diagonal": np.diag([1.0, 1.0, 1.0, 2.0, 2.0, 3.0]),
    "two clusters": with_values([1.0] * 30 + [0.5] * 34, 3),
    "close": with_values(1 + 1e-9 * np.arange(64), 4),
    "closer": with_values(1 + 1e-13 * np.arange(64), 5),
    "graded": with_values(np.logspace(0, -14, 64), 6),
    "rank four": with_values([5.0] * 4 + [0.0] * 60, 7),
    "huge": 1e150 * np.triu(np.random.default_rng(8).standard_normal((16, 16))),
    "tiny": 1e-150 * np.triu(np.random.default_rng(9).standard_normal((16, 16))),
    "split": np.kron(np.eye(4), np.triu(np.random.default_rng(10).standard_normal((8, 8)))),
}


@pytest.mark.parametrize("name", CASES)
def test_principal(name):
    r = CASES[name]
    values, vectors = wh.principal(r, 8)
    expected = np.linalg.svd(r, compute_uv=False)
    wanted = min(8, int((expected > expected[0] * wh._LEAST_SHARE).sum()))
    assert len(values) == wanted
    assert np.allclose(np.sqrt(values), expected[:wanted], rtol=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-12
    scaled = r / expected[0]
    assert np.abs(scaled.T @ (scaled @ vectors) - vectors * (values / expected[0] ** 2)).max() < 1e-12


@pytest.mark.parametrize("name", ["random", "close", "two", "rank four"])
def test_dqds_keeps_all_values(name):
    diagonal, above, _ = wh.bidiagonal(CASES[name])
    expected = np.linalg.svd(CASES[name], compute_uv=False)
    assert np.allclose(np.sqrt(wh.dqds(diagonal, above)), expected, atol=1e-13 * expected[0])


def test_dqds_is_accurate_for_small_values():
    """Relative accuracy for each value, however small: here the values are known."""
    diagonal = 10.0 ** -np.arange(0, 20, 2.0)
    found = np.sqrt(wh.dqds(diagonal, np.zeros(9)))
    assert np.allclose(found, diagonal, rtol=1e-15)
    bidiagonal = np.array([1.0, 1e-8]), np.array([1.0])
    product = np.prod(np.sqrt(wh.dqds(*bidiagonal)))
    assert abs(product / 1e-8 - 1) < 1e-14  # the determinant


def expected_rows(ids, vectors, k=8):
    x = np.stack([np.floor(1024 * np.array(v, dtype=float)) + 100000 for v in vectors]).astype(np.int64)
    n = len(x)
    y = n * x - x.sum(axis=0)
    centred = y / n
    value, direction = np.linalg.eigh(centred.T @ centred / n)
    value, direction = value[::-1], direction[:, ::-1]
    white = centred @ direction[:, :k] / np.sqrt(value[:k])
    return dict(zip(ids, (y * y).sum(axis=1).tolist(), strict=True)), white, value


def compare(found, ids, vectors, k):
    deviations, white, value = expected_rows(ids, vectors, k)
    rows = found.collect()
    assert len(rows) == len(ids) * k
    place = {v: i for i, v in enumerate(ids)}
    got = np.zeros_like(white)
    for row in rows:
        got[place[row.vec_id], row.component - 1] = row.whitened
        assert int(row.deviation) == deviations[row.vec_id] and row.n == len(ids)
        assert row.explained == pytest.approx(value[row.component - 1] / value.sum(), rel=1e-9)
        assert row.identity_error == rows[0].identity_error < 1e-9
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-9


@pytest.mark.parametrize("dimensions,k", [(12, 8), (3, 3)])
def test_rows(spark, monkeypatch, dimensions, k):
    rng = np.random.default_rng(dimensions)
    base = rng.standard_normal((70, dimensions)) * np.arange(1, dimensions + 1)
    vectors = [v.tolist() for v in base] + [base[0].tolist()] * 30 + [[0.0] * dimensions]
    nan, inf = [float("nan")] * dimensions, [1.0] * (dimensions - 1) + [float("inf")]
    odd = [None, [], nan, inf, [None] * dimensions, [1.0] * (dimensions + 1), [1e300] * dimensions]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(900 + i, v, 0) for i, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, x int").repartition(40)
    monkeypatch.setattr(wh, "_FAN", 4)  # several levels of merging
    found = wh.whiten(table)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(found, list(range(len(vectors))), vectors, k)


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.where("embedding is not null").collect()
    ok = [r for r in rows if all(x is not None and np.isfinite(x) for x in r.embedding)]
    compare(wh.whiten(table), [r.vec_id for r in ok], [r.embedding for r in ok], 8)


def test_large_numbers_stay_exact(spark):
    vectors = [[float(1 << 45), 1.0], [-float(1 << 45), 3.5], [0.25, 7.0]]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    x = [[int(1024 * c // 1) + 100000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    expected = {i: sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in wh.whiten(table).collect()} == expected


def test_without_variance(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(i, [0.5, 0.25]) for i in range(20)], [(1, None), (2, [])]):
        found = wh.whiten(spark.createDataFrame(rows, schema))
        assert found.count() == 0 and len(found.columns) == 7
    line = spark.createDataFrame([(i, [float(i), 2.0, -float(i)]) for i in range(5)] + [(None, [2.0, 2.0, -2.0])], schema)
    rows = wh.whiten(line).collect()
    assert len(rows) == 6 and {r.component for r in rows} == {1}
    assert rows[0].explained == pytest.approx(1.0) and {r.vec_id for r in rows} == {None, 0, 1, 2, 3, 4}
