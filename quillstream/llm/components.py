"""Connected components over a distributed table of links.

Edge cases: an empty table and links of a node with itself give no rows; repeated links count
once. Null nodes are not allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attached, forget, written

#: Alternating star steps need O(log n) rounds or few more; more than these is an error, not a result.
ROUNDS = 200
#: Up to so many links (16 bytes each) are joined in one task; more of them by distributed steps.
FEW = 1 << 20


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that aren't the least of their component, and that least node."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b[["u", "v"]].to_numpy(np.int64) for b in batches]
    if parts:
        links = np.concatenate(parts)
        node, root = joined(links[:, 0], links[:, 1])
        yield pd.DataFrame({"node": node, "root": root})


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Each node hands its larger neighbours to the least node it knows, itself included."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    known = attached(both, least, "u", "n", 2 * n_edges)
    return known.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    known = attached(edges, least, "u", "n", n_edges)
    moved = known.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """node, root for every node of the links (a, b) that isn't itself the least of its component.

    Alternating large-star and small-star steps until nothing changes. The least neighbours
    are partial aggregates; the links of a node with many of them (the least of a large
    component has all) stay where they are and meet its row by broadcast (``attached``). Every
    step is a table in the shared folder and the one before it is deleted, so a lost executor
    costs one step at most. At most ``few`` distinct links, 16 MB, are joined by one task instead, with
    the same result.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now, "links")
    before = mark(now)
    if before[0] <= few:
        return written(now.coalesce(1).mapInPandas(_joined, "node long, root long"), "roots")
    for _ in range(ROUNDS if before[0] else 0):
        large = written(_large_star(now, before[0]), "links")
        forget(now)
        now = written(_small_star(large, large.count()), "links")
        forget(large)
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components of {before[0]} links didn't settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
