"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

EDGE = "src long, dst long"


def forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component: (node, smallest node) for the nodes of these edges, roots left out."""
    nodes, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = flat[: len(src)], flat[len(src) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (jump := root[root]).tobytes() != root.tobytes():
            root = jump
        if np.array_equal(root, before):
            break
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task, a bounded number at a time, become the stars that connect the same nodes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def out():
        src, dst = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
        if n > 2_000_000:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(src, dst)`` (longs); root is the component's smallest node.

    Each round is a pair of grouped minima, so a node with very many neighbours is combined before the shuffle; rounds
    grow with the logarithm of the longest path. Lineage is cut every round.
    """
    edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src <> dst")
    edges = cut(edges.mapInArrow(contract, EDGE))
    seen = None
    while True:
        both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = both.filter("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        # every edge now points down; small star: hang all lower neighbours and the node on the lowest
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").filter("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        edges = cut(small.union(low.select("src", F.col("low").alias("dst"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
