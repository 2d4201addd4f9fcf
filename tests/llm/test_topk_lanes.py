"""Top-k search deals trees and queries out without a join; queries carry their best along."""

import numpy as np
import pytest

from veilframe.llm import topk


def frame(spark, rows):
    data = [(i, [float(x) for x in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "vec_id bigint, embedding array<double>")


def brute(rows, k, every):
    whole = np.floor(1024 * np.asarray(rows)).astype(np.int64)
    out = []
    for q in range(0, len(whole), every):
        scored = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return out


def test_copies_of_queries_are_never_broadcast(spark, monkeypatch):
    plans, real = [], topk.stored_once

    def noted(df, label):
        if label == "mtree-best":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(topk, "stored_once", noted)
    rows = np.random.default_rng(3).standard_normal((300, 6))
    got = topk.search(frame(spark, rows).repartition(3), every=5, block_rows=20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 10, 5)
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("lanes", [1, 2, 7])
def test_any_number_of_groups_and_lanes_finds_the_same(spark, monkeypatch, lanes):
    monkeypatch.setattr(topk, "_HELD", 2_000)  # so that queries take several groups
    rows = np.round(np.random.default_rng(lanes).standard_normal((260, 4)), 1)  # many ties
    index = topk.index_blocks(
        frame(spark, rows).withColumnsRenamed({"vec_id": "id", "embedding": "vector"}), block_rows=30
    )
    index = topk.stored_once(index, "test-index")
    queries = frame(spark, rows).where("vec_id % 4 = 0").toDF("id", "vector")
    got = topk.top_k(index, queries, k=5, lanes=lanes, size=8).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 5, 4)


@pytest.mark.parametrize("factor", [1, 2**9, 2**24, 2**29])
def test_best_are_carried_from_tree_to_tree(factor):
    # Products within 2^24, 2^53, beyond, and beyond 64 bits.
    rng = np.random.default_rng(5)
    rows = rng.integers(-40, 40, (900, 3)).astype(np.float64) * factor
    rows[::50] += 1
    ids = rng.permutation(900)
    asked = topk.Asked(rows[::30], ids[::30], 7)
    sizes = []
    for at in range(0, 900, 150):
        asked.search(topk.build_tree(ids[at : at + 150], rows[at : at + 150], page=8))
        sizes.append(asked.count.sum())
    assert sizes[0] == sizes[-1] == 7 * 30
    found = list(zip(*(x.tolist() for x in asked.found()), strict=True))
    exact = rows.astype(object)
    for n, q in enumerate(ids[::30].tolist()):
        scores = [max(topk._LOW, min(topk._HIGH, int(s))) for s in exact @ exact[30 * n]]
        want = sorted((-s, i) for s, i in zip(scores, ids.tolist(), strict=True) if i != q)[:7]
        assert [(-s, i) for name, i, s in found if name == q] == want


def test_copies_weigh_no_more_than_the_trees():
    gb = 1 << 30
    # 15 million vectors, every hundredth a query, 600 shuffle partitions, six cores.
    lanes, groups = topk.dealt(1500, 2 * gb, 302, gb // 50, gb // 20, 600, 6)
    assert 18 <= lanes * groups <= 600 and lanes * gb // 50 <= 1.1 * groups * 2 * gb and groups <= 2
    # Every vector a query: copies go both ways.
    lanes, groups = topk.dealt(1000, gb, 16_000, gb, 2 * gb, 600, 6)
    assert groups >= 32 and 1 <= lanes <= 4
    # One tree is searched for many groups at a time.
    lanes, groups = topk.dealt(1, 1 << 20, 300, 20 << 20, 50 << 20, 200, 6)
    assert lanes == 1 and groups >= 18
    assert topk.dealt(0, 0, 0, 0, 0, 4, 2) == (1, 1)
