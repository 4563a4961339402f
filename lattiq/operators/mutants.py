"""Deliberately faulty variants, as ground truth for bug detectors; never used by the canonical operators.

Faults of synchronisation alone (mixed kinds of locking, missing barriers) have no counterpart in a bulk-synchronous plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from ..graph import Graph
from .relax import UNREACHED, relax

LABELS = ("RaceBug", "BoundsBug", "NbrBoundsBug", "FieldBug", "PrecedenceBug", "OverflowBug", "LivelockBug", "UninitializedBug", "ExcessThreadsBug")


def faulty_graph(g: Graph, label: str, threads: int = 3) -> Graph:
    """``g`` as a loop with the fault would see it."""
    if label in ("BoundsBug", "ExcessThreadsBug"):  # one vertex too many, tied to the first
        extra = g.edges.sparkSession.createDataFrame([(-1, g.n, 0, 1), (-2, 0, g.n, 1)], "eid long, src long, dst long, weight long")
        return Graph(g.vertices.union(g.vertices.sparkSession.range(g.n, g.n + 1)), g.edges.unionByName(extra), g.n + 1)
    if label == "NbrBoundsBug":  # each list reads on into the next vertex's first neighbour
        first = g.edges.groupBy("src").agg(F.min("dst").alias("dst")).select((F.col("src") - 1).alias("src"), "dst").where("src >= 0")
        extra = first.select(F.lit(-1).cast("long").alias("eid"), "src", "dst", F.lit(1).cast("long").alias("weight"))
        return Graph(g.vertices, g.edges.unionByName(extra), g.n)
    if label == "FieldBug":  # runs over as many edges as there are vertices
        return Graph(g.vertices, g.edges.where(F.col("eid") < g.n), g.n)
    if label == "PrecedenceBug":  # id * (n / threads) leaves the tail out
        return Graph(g.vertices, g.edges.where(F.col("src") < threads * (g.n // threads)), g.n)
    return g


def mutant(g: Graph, source: int, label: str, kind: str = "hop", style: str = "vdp", max_iter: int = 200) -> DataFrame:
    """(id, val) of a relaxation with the fault; LivelockBug runs into DidNotConverge."""
    if label not in LABELS:
        raise ValueError(f"unknown fault {label!r}")
    broken = faulty_graph(g, label)
    unset = F.lit(None).cast("long")
    start = broken.vertices.select("id", F.when(F.col("id") == source, F.lit(0).cast("long")).otherwise(unset).alias("val"))
    if label == "OverflowBug":  # unreached vertices pass on a huge number too, and a step more wraps in 32 bits
        start, kind = start.select("id", F.coalesce("val", F.lit(UNREACHED).cast("long")).alias("val")), f"{kind}32"
    if label == "UninitializedBug":  # distances start with what the memory held, here a hash of the id below the number of vertices
        start = start.select("id", F.coalesce("val", hash32(F.col("id")) % broken.n).alias("val"))
    if label == "LivelockBug":  # with every row taken each round, equal values keep replacing each other
        style = "vtp"
    combine = F.max if label == "RaceBug" else F.min  # a lost update: the larger write survives
    return relax(broken, start, kind, style, max_iter, combine=combine, strict=label != "LivelockBug")
