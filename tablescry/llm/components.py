"""Connected components of an edge table, by contraction to random neighbours.

In each round every node goes over to whichever of itself and its neighbours comes first in
a random order drawn for the round (Lacki, Mirrokni and Wlodarczyk, "Connected Components at
Scale via Local Contractions"), and on from there once more; nodes that went the same way
become one node, and edges within it go. Whatever the ids and however long the paths, a
round leaves less than half of the nodes, so the number of rounds grows with the logarithm
of the number of nodes. The last ``LAST_EDGES`` edges, a constant, are joined in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescry.llm.common import Tables

COMPOSED = 4  # rounds whose steps are joined in one job
LAST_EDGES = 2_000


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, label): each node of the edges (a, b) with the smallest node it reaches.

    Edges may repeat, point either way or join a node with itself; edges with a null are left
    out; without edges the result is empty. Spent tables are dropped.
    """
    whole = edges.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long"))
    first = tables.keep(whole.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left, steps, spent = first.where("a <> b"), [], [first]
    while (edges_left := left.count()) > LAST_EDGES:
        step = _step(left, len(steps))
        beyond = step.toDF("into", "beyond")
        steps.append(tables.keep(step.join(beyond, "into").select("node", F.col("beyond").alias("into"))))
        one, other = steps[-1].toDF("a", "into_a"), steps[-1].toDF("b", "into_b")
        moved = left.join(one, "a").join(other, "b").where("into_a <> into_b")
        left = tables.keep(moved.select(F.least("into_a", "into_b").alias("a"), F.greatest("into_a", "into_b").alias("b")).distinct())
        spent.append(left)
        tables.drop(*spent[1:-1])
        del spent[1:-1]
    if edges_left:
        steps.append(tables.keep(left.coalesce(1).mapInArrow(_joined, "node long, into long")))
    nodes = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = nodes.select("node", F.col("node").alias("root")) if not steps else steps[-1].toDF("node", "root")
    for number, step in enumerate(reversed(steps[:-1]), 1):
        roots = step.join(roots.toDF("into", "root"), "into", "left").select("node", F.coalesce("root", "into").alias("root"))
        if number % COMPOSED == 0:
            roots = tables.keep(roots)
            spent.append(roots)
    roots = tables.keep(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    labels = tables.keep(roots.join(roots.groupBy("root").agg(F.min("node").alias("label")), "root").select("node", "label"))
    tables.drop(*spent, *steps, roots)
    return labels


def _step(edges: DataFrame, number: int) -> DataFrame:
    """(node, into): each node with the first of itself and its neighbours in this round's order."""

    def place(node: str) -> Column:
        return F.struct(F.xxhash64(node, F.lit(number)).alias("order"), F.col(node).alias("node"))

    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other")
    first = both.groupBy("node").agg(F.min(place("other")).alias("first"))
    return first.select("node", F.least("first", place("node")).getField("node").alias("into"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a few edges with the representative of its component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            parent[root(a)] = root(b)
    nodes = list(parent)
    yield pa.record_batch({"node": pa.array(nodes, pa.int64()), "into": pa.array([root(x) for x in nodes], pa.int64())})
