"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geocairn.plans.session import materialize

EDGE = "a long, b long"


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component, for links ``a[i] - b[i]`` among ``n`` nodes."""
    parent = np.arange(n)
    while a.size:
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        if not apart.any():
            break
        a, b, pa_, pb = a[apart], b[apart], pa_[apart], pb[apart]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
    return parent


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) that connect the same nodes as the links ``a - b``."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    top = roots(nodes.size, at[: a.size], at[a.size:])
    moved = top != np.arange(nodes.size)
    return nodes[moved], nodes[top[moved]]


def edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield edge_batch(*forest(batch.column(0).to_numpy(), batch.column(1).to_numpy()))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not its component's smallest node.

    Each task first replaces its batches of links by spanning stars. Then rounds of two steps run
    until nothing changes: larger neighbours move to the smallest neighbour, then the smaller ones
    do. Every step aggregates minima (summed per task) and joins them back on the node, a join that
    adaptive execution can split when one node has very many links. Each round is a table in the
    shared folder, so lost executors cost one round at most.
    """
    links = edges.select("a", "b").where("a <> b").mapInArrow(_thin, EDGE).distinct()
    links = materialize(links, "links")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if not state[0] or state == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        links = (both.where("b > a").join(least.hint("merge"), "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        links = (links.join(least.hint("merge"), "a")
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where("a <> b").distinct())
        links = materialize(links, "links")
