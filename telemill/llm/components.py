"""Connected components: each task joins its own edges, then alternating large and small stars join what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges that a task joins on its own.
EDGES_AT_ONCE = 1_000_000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges a, b -> their nodes, ascending, and of each the smallest node that it reaches by them."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        # of two roots with an edge the larger hangs under the smaller, and every node under its root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[root]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges a, b -> node, root: of each EDGES_AT_ONCE edges of a task the nodes, with the smallest that they reach by these."""

    def told() -> pa.RecordBatch:
        node, root = least_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])

    held, many = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("a", "b")])
        many += batch.num_rows
        if many > EDGES_AT_ONCE:
            yield told()
            held, many = [], 0
    if held:
        yield told()


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long) -> node, root: every node of an edge with the smallest node it reaches.

    Tasks of up to EDGES_AT_ONCE edges join these first: edges that one task
    holds are then done, without shuffles, and of more, as many as nodes of each
    task go on. Each round's minima are partial aggregates, so a node with very
    many edges costs its partition one row per upstream task; the joins back to
    the edges are ones that adaptive execution may split. No edges: no rows. The
    state is checkpointed each round in the shared folder.
    """
    e = common.settle(edges.where("a <> b").select("a", "b"))
    tasks = max(1, -(-e.count() // EDGES_AT_ONCE))
    found = common.settle(e.coalesce(tasks).mapInArrow(_joined, "node long, root long"))
    if tasks == 1:
        return found
    e = common.settle(found.where("node <> root").select(F.col("node").alias("hi"), F.col("root").alias("lo")).distinct())
    before = _state(e)
    while before[0]:
        # large star: each node's larger neighbours move to its smallest neighbour
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        # small star: each node's smaller neighbours, and itself, move to the smallest of them
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(small, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        e = common.settle(moved.unionAll(small.select("hi", F.col("m").alias("lo"))).distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    return e.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root").unionAll(e.select("lo", "lo")).distinct()
