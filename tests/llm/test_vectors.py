"""Vector near duplicates and exact search against brute force, edge rows."""

import numpy as np
import pytest

from veilframe.llm import topk, vectors


def clustered(rng, groups, size, dim, noise):
    base = rng.standard_normal((groups, dim))
    rows = np.repeat(base, size, axis=0) + noise * rng.standard_normal((groups * size, dim))
    return rows * rng.uniform(0.1, 10, (len(rows), 1))


def brute_links(rows, similarity):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= similarity
    np.fill_diagonal(near, False)
    low = np.arange(len(rows))
    while True:
        new = np.array([min(low[i], *low[near[i]]) if near[i].any() else low[i] for i in range(len(rows))])
        if (new == low).all():
            return near.sum(axis=1), low
        low = new


def frame(spark, rows, start=0):
    data = [(start + i, None if r is None else [None if x is None else float(x) for x in r], i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "vec_id bigint, embedding array<double>, kept int")


@pytest.mark.parametrize("block", [8, 1024])
def test_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = clustered(rng, 60, 12, 24, 0.18)
    rows[5] = rows[17]
    rows[700] = rows[17] * 3
    got = {r.vec_id: r for r in vectors.near_vectors(frame(spark, rows).repartition(4), block=block).collect()}
    links, low = brute_links(rows, 0.9)
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= links).all()
    assert found.sum() >= 0.99 * links.sum() > 0
    if (found == links).all():
        assert [got[i].component_id for i in range(len(rows))] == low.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_plan_grows_slowly():
    small, large = vectors.plan_for(10_000, 0.9), vectors.plan_for(10_000_000, 0.9)
    assert vectors.plan_for(50, 0.9).bits == 0
    assert small.bits < large.bits and large.tables < 6 * small.tables
    # A pair at the threshold meets in a cell and passes the count but for 0.3 %.
    rng = np.random.default_rng(0)
    plan, dim, met = small, 64, 0
    gauss = vectors._gaussians(1, dim, plan.bits * plan.tables)
    shared = vectors._gaussians(2, dim, plan.projections)
    for _ in range(400):
        u, w = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
        v = 0.9 * u + np.sqrt(1 - 0.81) * w
        cells = ((u @ gauss > 0) == (v @ gauss > 0)).reshape(plan.tables, plan.bits).all(axis=1)
        count = (np.abs((u - v) @ shared) <= plan.window).sum()
        met += bool(cells.any() and count >= plan.least)
    assert met >= 394


def test_collisions_are_windows():
    values = np.random.default_rng(1).standard_normal((40, 7))
    want = (np.abs(values[:, None, :] - values[None, :, :]) <= 0.5).sum(axis=2)
    assert (vectors.collisions(values, 0.5) == want).all()


BAD = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]


def test_link_edges(spark):
    rows = [*BAD, [1.0, 0.0], [1.0, 0.0], [2.0, 0.1], [-1.0, 0.0], [1.0, 0.0, 0.0], [1e200, 0.0], [1e-200, 0.0]]
    df = frame(spark, rows).union(spark.sql("select cast(null as bigint), array(1.0D, 0.0D), 1"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    for i in range(6):
        assert got[i] == (0, i, True)
    for i in (6, 7, 8, 11, 12):
        assert got[i] == (4, 6, i == 6)
    assert got[9] == (0, 9, True) and got[10] == (0, 10, True) and got[None] == (0, None, True)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def brute_top(rows, k, every):
    whole = {i: np.floor(1024 * np.array(r, dtype=float)) for i, r in enumerate(rows)
             if r is not None and None not in r and np.isfinite(r).all() and len(r)}
    out = []
    for q, v in whole.items():
        if q % every == 0:
            scored = sorted((-int(v @ w), i) for i, w in whole.items() if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [50, 8192])
def test_search_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(9)
    rows = list(clustered(rng, 30, 20, 8, 0.3) / 20)
    rows[40:60] = [rows[3]] * 20
    rows += [np.ones(3), np.ones(3) * 2, *BAD, np.zeros(8)]
    df = frame(spark, rows).repartition(3)
    got = topk.search(df, every=7, block_rows=block_rows).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, 10, 7)


def test_search_prunes_and_keeps_huge_scores(spark):
    rng = np.random.default_rng(2)
    rows = clustered(rng, 8, 500, 4, 0.01)
    ids = np.arange(len(rows))
    tree = topk.build_tree(ids, np.floor(1024 * rows))
    assert sorted(tree.ids.tolist()) == ids.tolist()
    for i in range(len(tree.route)):
        inside = tree.rows[tree.first[i] : tree.last[i]]
        assert (topk._distances(inside, tree.route[i]) <= tree.radius[i] + 1e-6).all()
    seen = []
    counted = topk._products
    topk._products = lambda a, b, e: (seen.append(a.shape[0] * b.shape[0]), counted(a, b, e))[1]
    try:
        topk.search_tree(tree, np.floor(1024 * rows[:5]), ids[:5], 10)
    finally:
        topk._products = counted
    assert sum(seen) < 0.5 * 5 * len(rows)
    big = frame(spark, [[1e15, 1.0], [1e15, 2.0], [1e15, 3.0]])
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(big, every=1).collect()}
    assert got[0, 1] == (1, 2**63 - 1)
    assert topk.search(big.limit(0)).count() == 0


def test_rounds_cover_all_trees_once():
    for trees in (0, 1, 2, 5, 6, 30, 1000):
        rounds = topk.rounds_of(trees)
        assert rounds[0][0] == 0.0 and rounds[-1][1] == 1.0
        assert all(a[1] == b[0] for a, b in zip(rounds, rounds[1:])) and len(rounds) <= 6


def test_floors_spare_products_and_rows(monkeypatch):
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((40, 16)) * 6
    rows = np.floor(64 * (centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16))))
    trees = [topk.build_tree(np.arange(i, 4000, 8), rows[i::8], page=16) for i in range(8)]
    ids, queries = np.arange(0, 4000, 100), rows[::100]
    products, real = [], topk._products
    monkeypatch.setattr(
        topk, "_products", lambda a, b, e: (products.append(a.shape[0] * b.shape[0]), real(a, b, e))[1]
    )
    alone = [topk.search_tree(t, queries, ids, 10) for t in trees]
    without = sum(products)
    products.clear()
    shared, floors = [], np.full(len(ids), topk._LOW, dtype=np.int64)
    for tree in trees:
        shared.append(topk.search_tree(tree, queries, ids, 10, floors))
        best = {}
        for q, v, s in (x for found in shared for x in found):
            best.setdefault(q, []).append((-s, v))
        floors = np.array([-sorted(best[q])[9][0] if len(best[q]) >= 10 else topk._LOW for q in ids])
    assert sum(products) < 0.9 * without and sum(map(len, shared)) < 0.6 * sum(map(len, alone))
    scores = queries.astype(np.int64) @ rows.astype(np.int64).T
    for n, q in enumerate(ids):
        expected = sorted((-s, v) for v, s in enumerate(scores[n].tolist()) if v != q)[:10]
        assert sorted(best[q])[:10] == expected


@pytest.mark.parametrize("block_rows", [16, 40])
def test_many_rounds_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    vectors = np.round(rng.standard_normal((400, 4)), 1)  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    got = topk.search(df.repartition(5), every=9, block_rows=block_rows).collect()
    whole = np.floor(1024 * vectors).astype(np.int64)
    for q in range(0, 400, 9):
        scores = whole @ whole[q]
        expected = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:10]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert mine == [(n + 1, v, -s) for n, (s, v) in enumerate(expected)]
