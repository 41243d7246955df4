"""Connected components of an edge table by contraction to local minima."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_health.session import cut_lineage

#: Edges that one task may finish; more are contracted by all tasks, round after round.
IN_ONE_TASK = 100_000


def _finish(frames):
    frames = list(frames)
    if not frames:
        return
    edges = pd.concat(frames)
    nodes, ends = np.unique(np.concatenate([edges["a"], edges["b"]]), return_inverse=True)
    a, b = ends[: len(edges)], ends[len(edges) :]
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]
    yield pd.DataFrame({"node": nodes, "label": nodes[label]})


def _roots(ends: DataFrame) -> DataFrame:
    """`node`, `label`: where the way over least neighbours ends, by pointer jumping."""
    labels = cut_lineage(ends.groupBy("node").agg(F.min("other").alias("m"))
                         .select("node", F.least("node", "m").alias("label")))
    while True:
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        made = cut_lineage(labels.join(further, "label").select(
            "node", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("moved")))
        labels = made.select("node", "label")
        if made.where("moved").isEmpty():
            return labels


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `label` (the least node it is connected with) of every node that has an edge to another.

    Each round merges every node with the local minimum that its way over least neighbours leads to,
    so at most half of the nodes remain, and only edges between what remains apart go on. Edges with
    a null end are left out. Every round is checkpointed; the driver sees how many edges are left. The
    last IN_ONE_TASK edges are finished by one task, since many rounds on few rows cost the driver most.
    """
    def distinct(found):
        return cut_lineage(found.where("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    left, rounds = distinct(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), []
    while left.count() > IN_ONE_TASK:
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        labels = _roots(ends)
        rounds.append(labels)
        merged = left.join(labels.withColumnsRenamed({"node": "a", "label": "x"}), "a").join(
            labels.withColumnsRenamed({"node": "b", "label": "y"}), "b")
        left = distinct(merged.select(F.col("x").alias("a"), F.col("y").alias("b")))
    kind = dict(left.dtypes)["a"]
    out = cut_lineage(left.coalesce(1).mapInPandas(_finish, f"node {kind}, label {kind}"))
    while rounds:
        later = out.select(F.col("node").alias("label"), F.col("label").alias("last"))
        out = cut_lineage(rounds.pop().join(later, "label", "left").select(
            "node", F.coalesce("last", "label").alias("label")))
    return out
