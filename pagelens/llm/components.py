"""Connected components of an edge table by contraction and alternating stars.

A task contracts the edges it holds to a forest of stars, in numpy. Edges are
held by as many tasks as their number asks for; where that is one task, its
stars are the components. Otherwise a round of large and small stars over all
tasks follows, and the shrunken edges are contracted again.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagelens.operators.shared import cut

# Edges that a task holds on average.
TASK_EDGES = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id that is not the least of its component, and that least id."""
    ids, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = of[: len(a)], of[len(a) :]
    parent = np.arange(len(ids))
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(parent, high[apart], low[apart])
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above
    under = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[under], ids[parent[under]]


def _contracted(edges: DataFrame) -> DataFrame:
    """``(u, v)``: the stars of each task's edges; loops and repeats go."""

    def run(batches):
        held = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        many = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            many += batch.num_rows
            if many > 2 * TASK_EDGES:
                held = [stars(*(np.concatenate(side) for side in zip(*held)))]
                many = len(held[0][0])
        u, v = stars(*(np.concatenate(side) for side in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return edges.mapInArrow(run, "u bigint, v bigint")


def _star(edges: DataFrame) -> DataFrame:
    """Rows ``(v, m)``: each ``v`` seen from ``u`` with the least of u's star.

    The least is an aggregate that combines before the shuffle, and the join
    back is on a key whose rows adaptive execution may split.
    """
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return edges.join(least, "u")


def _round(now: DataFrame) -> DataFrame:
    """One large and one small star of every id."""
    both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = _star(large.distinct())
    return (
        small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(small.select("u", F.col("m").alias("v")))
        .filter("u <> v")
        .distinct()
    )


def components(edges: DataFrame, most: int) -> DataFrame:
    """``(id, root)`` for every id of ``edges(a, b)``; root is the least id.

    There are ``most`` edges or fewer. An id that only meets itself is left
    out. Each round is checkpointed. Rounds end when the edges no longer
    change, which is compared by their count and a hash over all of them.
    """
    tasks = max(1, -(-most // TASK_EDGES))
    now = cut(_contracted(edges.select("a", "b").repartition(tasks)))
    seen = None
    while tasks > 1:
        mark = now.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.max("u")
        ).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        tasks = -(-mark[0] // TASK_EDGES)
        held = _contracted(now.coalesce(tasks))
        now = cut(held if tasks == 1 else _round(held))
    roots = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
