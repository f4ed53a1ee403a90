"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is an equi-join and partial aggregates, so a node with a third of
all edges is split, not gathered; each round is written to the shared folder, and the one before it removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitquarry.llm._common import drop_folder, materialize

CHUNK = 2_000_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest node) with the same components as the edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[x], parent[y])
        before = parent.copy()
        np.minimum.at(parent, parent[x], low)
        np.minimum.at(parent, parent[y], low)
        np.minimum.at(parent, x, low)
        np.minimum.at(parent, y, low)
        parent = parent[parent]
        if np.array_equal(parent, before):
            break
    keep = parent != np.arange(len(nodes))
    return nodes[keep], nodes[parent[keep]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contracts what a task has, in chunks of bounded size."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        return contract(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size > CHUNK:
            a, r = flush()
            if len(a) > CHUNK // 2:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(r)], names=["u", "v"])
                held, size = [], 0
            else:
                held, size = [(a, r)], len(a)
    if size:
        a, r = flush()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(r)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of edges (two long columns); loops are left out."""
    a, b = edges.columns
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    now = materialize(edges.mapInArrow(_local, "u bigint, v bigint"))
    last = None
    while True:  # a logarithm of the nodes in rounds
        # large star: neighbours above u get the smallest of u and its neighbours
        start = now
        both = now.union(now.select("v", "u"))
        # written, so that the join stands alone and a node with many edges can be split
        lowest = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        now = both.filter("v > u").join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its neighbours below get the smallest of them
        down = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = down.join(low, "u")
        now = materialize(moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
        drop_folder(start)
        drop_folder(lowest)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select("root", "root").distinct())
