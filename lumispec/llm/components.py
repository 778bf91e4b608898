"""Connected components of links by local forests and alternating large-star and small-star steps; nothing is gathered on the driver but a count
and a checksum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util as U

#: Links that a task joins into a forest at once.
FOREST = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links that aren't the smallest of their component, and the smallest of it."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, b, a)
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        u, v = forest(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(2)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= FOREST:
            yield joined()
            held = []
    if held:
        yield joined()


def _star(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step on what the tasks' own forests leave. A centre's links may be most of all rows: what a join meets is a
    written table on both sides, so that Spark can split it."""
    edges = U.written(edges.mapInArrow(_forests, "u long, v long"))
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = U.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    large = U.written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v"))
    least = U.written(large.groupBy("u").agg(F.min("v").alias("m")))
    moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v) to (node, label): label is the smallest node reachable. Nodes without links are left out. Each round is a written table, and so
    is the result, so that Spark can split joins with it."""
    edges, before = links.select("u", "v").where("u != v"), None
    while True:
        edges = U.written(_star(edges))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return U.written(labels.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()))
