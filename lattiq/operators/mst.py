"""Minimum spanning forest by rounds of least edges per component, ties broken by edge id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.iterate import cut, release


def _roots(hooks: DataFrame) -> DataFrame:
    """(rep, root) by pointer jumping; in each two-cycle of hooks(rep, to) the smaller end is the root."""
    back = hooks.select(F.col("rep").alias("to"), F.col("to").alias("back"))
    joined = hooks.join(back, "to", "left")
    root = F.when((F.col("back") == F.col("rep")) & (F.col("rep") < F.col("to")), F.col("rep")).otherwise(F.col("to"))
    parent = cut(joined.select("rep", root.alias("root")))
    while True:
        up = parent.select(F.col("rep").alias("root"), F.col("root").alias("next"))
        jumped = cut(parent.join(up, "root", "left").select("rep", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")))
        before, parent = parent, jumped.select("rep", "root")
        release(before)
        if jumped.where("moved").isEmpty():
            return parent


def mst(g: Graph, style: str = "edge", driver: str = "data") -> DataFrame:
    """(eid, src, dst, weight) of the forest's edges, each once (src < dst).

    ``edge`` scans all edges that still cross components; ``vertex`` first reduces them to each vertex's least edge.  ``data`` rounds carry the
    crossing edges on; ``topo`` rounds take all edges again and look up both ends' components.
    """
    if style not in ("edge", "vertex") or driver not in ("topo", "data"):
        raise ValueError(f"unknown style {style!r} or driver {driver!r}")
    every = g.upper().select("eid", "src", "dst", "weight")
    live = cut(every.select("*", F.col("src").alias("a"), F.col("dst").alias("b")))
    names = g.vertices.select("id", F.col("id").alias("rep")) if driver == "topo" else None
    chosen: DataFrame | None = None
    key = F.struct("weight", "eid")
    while not live.isEmpty():
        ends = live.select(F.col("src").alias("v"), F.col("a").alias("rep"), F.col("b").alias("to"), "weight", "eid")
        ends = ends.union(live.select(F.col("dst"), F.col("b"), F.col("a"), "weight", "eid"))
        if style == "vertex":
            ends = ends.groupBy("v", "rep").agg(F.min(F.struct(key.alias("k"), "to")).alias("m")).select("rep", F.col("m.to").alias("to"), F.col("m.k.weight").alias("weight"), F.col("m.k.eid").alias("eid"))
        least = cut(ends.groupBy("rep").agg(F.min(F.struct(key.alias("k"), "to")).alias("m")).select("rep", F.col("m.to").alias("to"), F.col("m.k.eid").alias("eid")))
        round_ = least.select("eid").distinct()
        chosen = cut(round_ if chosen is None else chosen.union(round_))
        roots = _roots(least.select("rep", "to"))
        of = lambda end: roots.select(F.col("rep").alias(end), F.col("root").alias(f"{end}_root"))
        before = live
        if names is None:
            moved = live.join(of("a"), "a").join(of("b"), "b").where("a_root <> b_root")
            live = cut(moved.select("eid", "src", "dst", "weight", F.col("a_root").alias("a"), F.col("b_root").alias("b")))
        else:
            renamed = names.join(roots, "rep", "left").select("id", F.coalesce("root", "rep").alias("rep"))
            old, names = names, cut(renamed)
            release(old)
            end = lambda c, to: names.select(F.col("id").alias(c), F.col("rep").alias(to))
            live = cut(every.join(end("src", "a"), "src").join(end("dst", "b"), "dst").where("a <> b").select("eid", "src", "dst", "weight", "a", "b"))
        release(before)
    if chosen is None:
        return g.upper()
    return g.edges.join(chosen, "eid", "left_semi")


def total(forest: DataFrame) -> DataFrame:
    return forest.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("weight"))
