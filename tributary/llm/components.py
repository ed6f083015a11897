"""Connected components of an edge list by alternating large and small stars, for edge lists of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import cut, release


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (larger node, smallest node) of the components that the edges a-b form."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if find(x) != x]
    return np.array(nodes, dtype=np.int64), np.array([find(x) for x in nodes], dtype=np.int64)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])


#: So many edges are worth no rounds: one task joins them.
FEW = 10_000


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes of all edges that a task has."""
    ends = [(t.column(0).to_numpy(), t.column(1).to_numpy()) for t in batches]
    a, b = (np.concatenate(x) for x in zip(*ends, strict=True)) if ends else (np.empty(0, dtype=np.int64),) * 2
    u, v = forest(a, b)
    roots = np.unique(v)
    yield pa.record_batch([pa.array(np.concatenate([u, roots])), pa.array(np.concatenate([v, roots]))], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Edges are pairs of longs in any direction; repeated edges and loops do no harm, edges with a null are ignored.
    Each batch of edges is first replaced by its spanning stars, so dense groups shrink before they are shuffled.
    Then large-star and small-star steps alternate until nothing changes. The minima are aggregated before they are
    shuffled and joined as tables of their own, so that AQE can split the rows of a hub. Nothing is collected. Where no
    more than FEW edges are left after the first step, one task ends it, with the same result.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    pairs = pairs.where("u is not null and v is not null and u <> v")
    now = cut(pairs.mapInArrow(_forests, "u long, v long").distinct())
    if now.count() <= FEW:
        return now.repartition(1).mapInArrow(_whole, "node long, root long")
    for _ in range(rounds):
        # Large star: every larger neighbour of u goes to the smallest node that u knows.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(least, "u").groupBy(F.col("v").alias("u"), F.col("m").alias("v")).agg(F.max(F.expr("m <> u")).alias("moved")))
        # Small star: every smaller neighbour of u, and u, go to the smallest one.
        least2 = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        if large.where("moved").isEmpty() and least2.where("n > 1").isEmpty():  # neither step changes an edge
            release(least, large, least2)
            break
        rest = large.join(least2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(rest.unionByName(least2.select("u", F.col("m").alias("v"))).distinct())
        release(now, least, large, least2)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
