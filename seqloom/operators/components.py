"""Connected components of an edge table by alternating star contraction.

Every round is two grouped minima and two equi joins; no adjacency list is ever collected, and the
join against the one-row-per-node minimum table is one Spark can split when a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqloom.runtime import cut


def _least(edges: DataFrame, by: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(by).alias("node")).agg(F.min(other).alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node moves to the node's least neighbour (itself included)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = _least(both, "u", "v").select("node", F.least("node", "least").alias("least"))
    moved = both.filter("v > u").join(least, F.col("u") == F.col("node")).select(F.col("least").alias("a"), F.col("v").alias("b"))
    return moved.filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them. Edges come as a < b."""
    least = _least(edges, "b", "a")
    moved = edges.join(least, F.col("b") == F.col("node")).select(F.col("least").alias("x"), F.col("a").alias("y"))
    kept = least.select(F.col("least").alias("x"), F.col("node").alias("y"))
    return moved.filter("x <> y").unionAll(kept).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: any orderable type) -> (node, component): component is the least node reachable.

    Nodes without edges do not appear; self loops and null ends are dropped; repeats and direction
    do not matter. Stops when a round changes nothing (each round's edge set is compared by count
    and an order-free sum of hashes).
    """
    kind = edges.schema["a"].dataType
    now = cut(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct(), each=2
    )
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == mark or mark[0] == 0:
            break
        before = mark
        now = cut(_small_star(_large_star(now)), each=2)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(roots).select(F.col("node").cast(kind), F.col("component").cast(kind))
