"""Connected components of a graph of any size, without a hot vertex ever meeting in one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import durable, forget


def components(edges: DataFrame) -> DataFrame:
    """(node, root): one root for each connected component of ``edges`` (u long, v long).

    Every round hooks each vertex to its smallest neighbour, jumps once, and
    contracts the graph; the smallest neighbour is a sum with partial
    aggregation, and joins are on vertices, where adaptive execution splits a
    hot one.  Vertices should be numbered at random (hashes), so that the graph
    shrinks by a constant factor in a round.  Loops and repeats are ignored,
    nulls are dropped, an empty table gives an empty result.
    """
    left = durable(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    names = None
    while True:
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = durable(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("up")), "hooks")
        jump = durable(
            hook.alias("a").join(hook.alias("b"), F.col("a.up") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.up").alias("up")), "jumps"
        )
        if names is None:
            names = durable(jump.select("node", F.col("up").alias("root")), "names")
        else:
            new = durable(
                names.alias("n").join(jump.alias("j"), F.col("n.root") == F.col("j.node"), "left").select("n.node", F.coalesce("j.up", "n.root").alias("root")), "names"
            )
            forget(names)
            names = new
        ends = left.join(jump.select(F.col("node").alias("u"), F.col("up").alias("pu")), "u").join(jump.select(F.col("node").alias("v"), F.col("up").alias("pv")), "v")
        rest = durable(ends.where("pu != pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        for x in (left, hook, jump):
            forget(x)
        left = rest
        if left.isEmpty():
            return names


def root_of(up: np.ndarray) -> np.ndarray:
    """Roots of a forest of parent indices."""
    while True:
        nxt = up[up]
        if (nxt == up).all():
            return up
        up = nxt


def unite(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i[k] and j[k] for all k, in place; roots are the smallest indices."""
    while True:
        up[:] = root_of(up)
        a, b = up[i], up[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
