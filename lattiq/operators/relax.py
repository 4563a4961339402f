"""Breadth-first search, shortest paths and connected components: one monotone relaxation in six plan styles.

Style names: vertex (v) plans join vertices with adjacency arrays that are built once (a hub's in rows of ``HUB`` neighbours), edge (e) plans from the flat edge table; topology-driven
(t) plans take every row each round, data-driven (d) ones only what the last round improved; push (p) plans group by the edge's
target after joining its source, pull (l) plans the other way round.  All reach the same fixpoint; all but the
pull plans need no symmetric graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import wrap32
from ..graph import Graph
from ..plans.iterate import cut, release, until_unchanged

STYLES = ("vtp", "vtl", "vdp", "vdl", "et", "ed")
UNREACHED = 2147483647
#: Neighbours in a row of an adjacency table.
HUB = 4096


def _value(kind: str) -> Column:
    kinds = {"hop": F.col("val") + 1, "weight": F.col("val") + F.col("weight"), "label": F.col("val")}
    # sums of 32 bits, for the mutants only
    kinds |= {"hop32": wrap32(kinds["hop"]), "weight32": wrap32(kinds["weight"])}
    return kinds[kind]


def relax(
    g: Graph, start: DataFrame, kind: str, style: str = "vdp", max_iter: int = 100_000, combine=F.min, strict: bool = True
) -> DataFrame:
    """(id, val): the least fixpoint above ``start(id, val)``; null values are unreached.

    ``combine`` and ``strict`` exist for the mutants: another aggregate loses updates, a test that is not strict never ends.
    """
    if style not in STYLES:
        raise ValueError(f"unknown style {style!r}")
    vertex, data, pull = style[0] == "v", style[1] == "d", style.endswith("l")
    if vertex:
        # edge ids follow (src, dst), so a hub's edges fall into several rows without a sort
        chunk = F.floor(F.col("eid") / HUB).alias("chunk")
        lists = cut(g.edges.groupBy("src", chunk).agg(F.collect_list(F.struct("dst", "weight")).alias("out")).drop("chunk"))
    else:
        lists = g.edges.select("src", "dst", "weight")

    def opened(rows: DataFrame, *kept: str) -> DataFrame:
        """Edges of rows of ``lists``."""
        if not vertex:
            return rows.select("src", "dst", "weight", *kept)
        return rows.select("src", F.explode("out").alias("e"), *kept).select("src", F.col("e.dst").alias("dst"), F.col("e.weight").alias("weight"), *kept)

    def candidates(state: DataFrame) -> DataFrame:
        known = state.where("val is not null").select(F.col("id").alias("k_id"), "val")
        moved = state.where("changed and val is not null").select(F.col("id").alias("m_id"))
        if pull:
            mine = lists
            if data:  # only vertices next to one that improved look at their neighbours
                near = opened(lists.join(moved, F.col("src") == F.col("m_id"), "left_semi"))
                mine = lists.join(near.select(F.col("dst").alias("a_id")).distinct(), F.col("src") == F.col("a_id"), "left_semi")
            joined = opened(mine).join(known, F.col("dst") == F.col("k_id"))
            return joined.groupBy(F.col("src").alias("c_id")).agg(combine(_value(kind)).alias("cand"))
        if style == "vdp":
            known = state.where("changed and val is not null").select(F.col("id").alias("k_id"), "val")
        mine = lists.join(moved, F.col("src") == F.col("m_id"), "left_semi") if style == "ed" else lists
        joined = opened(mine.join(known, F.col("src") == F.col("k_id")), "val").withColumn("new", _value(kind))
        if not vertex:  # both ends' states, before grouping
            other = state.select(F.col("id").alias("o_id"), F.col("val").alias("o_val"))
            joined = joined.join(other, F.col("dst") == F.col("o_id")).where(_better("new", "o_val", strict))
        return joined.groupBy(F.col("dst").alias("c_id")).agg(combine("new").alias("cand"))

    def step(state: DataFrame) -> DataFrame:
        merged = state.drop("changed").join(candidates(state), F.col("id") == F.col("c_id"), "left")
        changed = F.col("cand").isNotNull() & _better("cand", "val", strict)
        val = F.least("val", "cand") if combine is F.min else F.when(changed, F.col("cand")).otherwise(F.col("val"))
        return merged.select("id", val.alias("val"), changed.alias("changed"))

    first = start.select("id", F.col("val").cast("long"), F.col("val").isNotNull().alias("changed"))
    try:
        return until_unchanged(first, step, max_iter).select("id", "val")
    finally:
        release(lists)


def _better(new: str, old: str, strict: bool) -> Column:
    test = F.col(new) < F.col(old) if strict else F.col(new) <= F.col(old)
    return F.col(old).isNull() | test


def _from_source(g: Graph, source: int) -> DataFrame:
    g.check_source(source)
    return g.vertices.select("id", F.when(F.col("id") == source, F.lit(0).cast("long")).alias("val"))


def bfs(g: Graph, source: int, style: str = "vdp", **options) -> DataFrame:
    """(id, dist): number of edges from ``source``, null where unreached."""
    return relax(g, _from_source(g, source), "hop", style, **options).withColumnRenamed("val", "dist")


def sssp(g: Graph, source: int, style: str = "vdp", **options) -> DataFrame:
    """(id, dist): least sum of weights (which are not negative) from ``source``, null where unreached."""
    return relax(g, _from_source(g, source), "weight", style, **options).withColumnRenamed("val", "dist")


def cc(g: Graph, style: str = "vdp", **options) -> DataFrame:
    """(id, label): smallest id of the component."""
    return relax(g, g.vertices.select("id", F.col("id").alias("val")), "label", style, **options).withColumnRenamed("val", "label")


def cc_hook(g: Graph) -> DataFrame:
    """(id, label) as ``cc``, in a number of rounds that grows with the logarithm of the vertices, not with the diameter: vertices hook to their
    smallest neighbour, pointers jump to the roots, edges are contracted to roots."""
    live = cut(g.edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    labels = g.vertices.select("id", F.col("id").alias("label"))
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        parent = cut(both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")))
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("next"))
            after = cut(parent.join(up, "p").select("a", F.col("next").alias("p"), (F.col("next") != F.col("p")).alias("moved")))
            release(parent)
            parent, done = after, after.where("moved").isEmpty()
            if done:
                break
        of = lambda end: parent.select(F.col("a").alias(end), F.col("p").alias(f"{end}p"))
        renamed = labels.join(parent.select(F.col("a").alias("label"), "p"), "label", "left").select("id", F.coalesce("p", "label").alias("label"))
        before, labels = labels, cut(renamed)
        release(before)
        rest = live.join(of("a"), "a").join(of("b"), "b").where("ap <> bp").select(F.greatest("ap", "bp").alias("a"), F.least("ap", "bp").alias("b"))
        before, live = live, cut(rest.distinct())
        release(before)
        release(parent)
    return labels


def farthest(dist: DataFrame) -> DataFrame:
    """One row: the smallest id at the largest distance, unreached vertices being infinitely far."""
    far = F.coalesce("dist", F.lit(UNREACHED).cast("long"))
    return dist.agg(F.max_by("id", F.struct(far, -F.col("id"))).alias("id"), F.max(far).alias("dist"))


def component_count(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count_distinct("label").alias("components"))
