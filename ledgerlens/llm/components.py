"""Connected components of an edge table by contraction with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.session import Scratch


def _apart(edges: DataFrame) -> DataFrame:
    """The edges (``u``, ``v``) between different nodes, each once."""
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node of an edge.

    Each round takes the smallest node among the neighbours and then the one of that one, puts
    it in the place of the node and goes on with the edges that are left between different nodes. The
    smallest node of a component always stays, and others at least halve, so rounds grow with the
    logarithm of the nodes and later ones read few edges. Every round is written to the shared
    folder; joins by node leave hot nodes to adaptive splitting, and groupings are fed by partial ones.
    """
    open_edges = scratch.keep(_apart(edges.select(F.col(left).alias("u"), F.col(right).alias("v"))), "edges")
    moves: list[DataFrame] = []
    while not moves or not open_edges.isEmpty():
        both = open_edges.union(open_edges.select("v", "u"))
        near = scratch.keep(both.groupBy("u").agg(F.min("v").alias("v")).select(
            F.col("u").alias("node"), F.least("u", "v").alias("low")), "near")
        moved = scratch.keep(near.join(near.select(F.col("node").alias("low"), F.col("low").alias("component")), "low").select(
            "node", "component"), "labels")
        moves.append(moved)
        open_edges = scratch.keep(_apart(
            open_edges.join(moved.select(F.col("node").alias("u"), F.col("component").alias("low_u")), "u")
            .join(moved.select(F.col("node").alias("v"), F.col("component").alias("low_v")), "v")
            .select(F.col("low_u").alias("u"), F.col("low_v").alias("v"))), "edges")
    labels = moves[0]
    for moved in moves[1:]:
        further = moved.select(F.col("node").alias("component"), F.col("component").alias("lower"))
        labels = labels.join(further, "component", "left").select("node", F.coalesce("lower", "component").alias("component"))
    return scratch.keep(labels, "labels") if len(moves) > 1 else labels
