"""Connected components by alternating large-star and small-star steps, all of them joins on shuffled tables; forests within a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _to_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Each node u links its neighbours v (the larger ones, or all) to the least of its neighbours and itself."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = edges.join(least, "u")
    if larger_only:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (u, v): the least node that can be reached.  Nodes alone don't appear.

    Large-star turns towards each node's least neighbour, small-star does so among the smaller ones, until every edge
    points at a node that points nowhere.  Each pass is written to the shared folder, so a lost executor costs one pass.
    """
    current = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, larger_only=True).distinct()
        small = materialize(_to_least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), larger_only=False).distinct(), "edges")
        release(current)
        current = small
        onward = small.join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
        forked = small.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        if onward.union(forked).agg(F.count("*")).first()[0] == 0:
            break
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least node of its component, node) that connect what the edges (u, v) connect."""
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, a, low)
        np.minimum.at(fresh, b, low)
        np.minimum.at(fresh, label[a], low)
        np.minimum.at(fresh, label[b], low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    keep = label != np.arange(len(nodes))
    return nodes[label[keep]], nodes[keep]
