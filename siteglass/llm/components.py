"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


#: Edges up to which what is joined with them is broadcast: two longs for each.
BROADCAST_EDGES = 500_000


def _large_star(e: DataFrame, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(hint(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(e: DataFrame, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(hint(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every end of edges (a, b): root is the component's smallest id. Loops and repeats do no harm.

    Every step is a groupBy with partial aggregation and a join of written tables, which
    adaptive execution splits where a hub has many edges. Null ends are dropped.
    """
    e = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        hint = F.broadcast if e.count() <= BROADCAST_EDGES else (lambda x: x)
        large = written(_large_star(e, hint), "large")
        small = written(_small_star(large, hint), "small")
        drop(e, large)
        e = small
        # done when no root has a parent, and so no end has two
        parents = e.select(F.col("a").alias("b"))
        if not e.join(hint(parents), "b", "left_semi").limit(1).count() and not e.groupBy("a").count().where("count > 1").limit(1).count():
            break
    found = e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
    found = written(found, "roots")
    drop(e)
    return found


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its component) that connect what the edges (a, b) of one task connect."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    far = np.flatnonzero(label != np.arange(len(ids)))
    return ids[far], ids[label[far]]
