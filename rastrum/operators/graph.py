"""Connected components of an edge list by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combine and two equi-joins whose large side may be
skewed and split by adaptive execution, so neither a hub nor a giant component lands in one task. Before
the rounds each task contracts its own edges, ONE_TASK at a time, to a spanning forest. As soon as no more
than ONE_TASK edges are left, one task of that bounded size settles them, which saves the last rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rastrum.session import by_shuffle, checkpoint

ONE_TASK = 400_000  # edges that a task settles at once, some 30 MB


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of edges between u and v, by hooking roots to smaller ones and jumping pointers."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[root]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) edges as a spanning forest: each node with the smallest that it reaches within ONE_TASK edges."""

    def flush():
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        nodes, least = least_reachable(u, v)
        own = nodes != least
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(least[own])], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        for s in range(0, batch.num_rows, max(1, ONE_TASK)):
            held.append(batch.slice(s, max(1, ONE_TASK)))
            n += held[-1].num_rows
            if n >= ONE_TASK:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for each node of an undirected edge list of whole numbers; component is the smallest node reachable.

    Edges with a null end and self loops are ignored; repeated edges count once; an empty list gives an
    empty result. Nodes without an edge do not appear.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    own = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = checkpoint(own.mapInArrow(_contracted, "u long, v long"))
    stars = lambda e: e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] <= ONE_TASK:
            return stars(checkpoint(e.coalesce(1).mapInArrow(_contracted, "u long, v long")))
        if now == seen:
            return stars(e)
        seen = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(by_shuffle(least), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(by_shuffle(low), "a").where("b <> m").select(F.col("b").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.union(low.select(F.col("a").alias("u"), F.col("m").alias("v"))).distinct())
