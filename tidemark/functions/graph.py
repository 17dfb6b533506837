"""Connected components: of edges in memory, and of an edge table by repeated contraction, in stored tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import Stored

ONE_TASK_EDGES = 2_000_000


def labelled(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of the component) of the edges x, y."""
    nodes, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(b.column("x").to_numpy(), b.column("y").to_numpy()) for b in batches]
        if parts:
            nodes, comp = labelled(*(np.concatenate(c) for c in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(comp)], ["node", "comp"])

    return edges.coalesce(1).mapInArrow(run, "node long, comp long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges(x, y); comp is the least node of its component.

    Up to ONE_TASK_EDGES stored edges (32 MB) are labelled by one executor task. Beyond that, each round hangs every node under its least neighbour, jumps once, and contracts the edges; a round at
    least halves the nodes of every component that is left. All joins read stored tables on both sides, so
    that Spark may split a node with very many edges.
    """
    own = edges.select("x", "y").where("x != y")
    if own.count() <= ONE_TASK_EDGES:
        return Stored(_in_one_task(own)).read()
    table = Stored(own.unionByName(own.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    known: Stored | None = None
    while True:
        e = table.read()
        parent = Stored(e.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("parent")))
        p = parent.read()
        up = p.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = Stored(p.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent")))
        parent.drop()
        p = jumped.read()
        if known is None:
            mapped = Stored(p.select("node", F.col("parent").alias("comp")))
        else:
            mapped = Stored(known.read().join(p.select(F.col("node").alias("comp"), "parent"), "comp", "left").select("node", F.coalesce("parent", "comp").alias("comp")))
            known.drop()
        known = mapped
        left, right = p.select(F.col("node").alias("x"), F.col("parent").alias("px")), p.select(F.col("node").alias("y"), F.col("parent").alias("py"))
        half = Stored(e.join(left, "x").select("px", "y"))
        rest = Stored(half.read().join(right, "y").where("px != py").select(F.col("px").alias("x"), F.col("py").alias("y")).distinct())
        half.drop()
        jumped.drop()
        table.drop()
        table = rest
        if rest.read().isEmpty():
            rest.drop()
            return known.read()
