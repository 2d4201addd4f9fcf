"""Connected components of a link table, by rounds of joins and minimum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import stored_once


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node with a link; component is its smallest reachable id.

    Alternating star contraction: each node's larger neighbours are moved to its smallest
    neighbour, then its smaller ones, until only stars around the minima are left, which
    takes about log(n) rounds. Every round is written, so lineage stays short and a lost
    executor costs one round. Hubs are summed up before the shuffle and their rows joined
    on, where adaptive execution splits them; nothing is gathered per node.
    """
    edges = stored_once(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "components",
    )
    last = None
    for _ in range(max_rounds):
        mark = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if mark == last:
            break
        last = mark
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m")
        )
        # Larger neighbours of u now point to the smallest node around u.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), "m").distinct()
        smallest = large.groupBy("u").agg(F.min("m").alias("s"))
        joined = large.join(smallest, "u")
        small = joined.where("m != s").select(F.col("m").alias("u"), F.col("s").alias("v")).union(
            smallest.select("u", F.col("s").alias("v"))
        )
        edges = stored_once(small.where("u != v").distinct(), "components")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    inner = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return inner.union(roots)
