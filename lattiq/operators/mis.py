"""Maximal independent set: the greedy set under the total order (priority, id).

Each round an undecided vertex is left out if a better neighbour is in, and taken in if every better neighbour
is out.  Topology-driven rounds (``mis``) take every vertex; data-driven ones (``mis_data``) only the undecided ones and the edges between
them.  Styles: ``pull`` looks at better neighbours, ``push`` has the included tell their neighbours, ``edge`` marks the ends of
edges that lose and takes in what is not marked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import mis_priority
from ..graph import Graph
from ..plans.iterate import DidNotConverge, cut, release

UNDECIDED, INCLUDED, EXCLUDED = 0, 1, 2
MODES = ("u32", "s32", "u32_mod1000", "u64", "u64_mod")


def better_edges(g: Graph, mode: str) -> DataFrame:
    """(v, w) for edges whose far end w comes before v in the order."""
    order = lambda c: F.struct(mis_priority(F.col(c), mode).alias("p"), F.col(c).alias("v"))
    return g.edges.where("src <> dst").where(order("dst") > order("src")).select(F.col("src").alias("v"), F.col("dst").alias("w"))


def mis(g: Graph, style: str = "pull", mode: str = "u32", max_iter: int = 100_000) -> DataFrame:
    """(id, status): 1 for members, 2 for the others."""
    better = cut(better_edges(g, mode))
    state = cut(g.vertices.select("id", F.lit(UNDECIDED).alias("status")))
    for _ in range(max_iter):
        far = state.select(F.col("id").alias("f_id"), F.col("status").alias("f_status"))
        seen = better.join(far, F.col("w") == F.col("f_id"))
        if style == "pull":
            about = seen.groupBy("v").agg(F.bool_or(F.col("f_status") == INCLUDED).alias("beaten"), F.bool_or(F.col("f_status") == UNDECIDED).alias("waits"))
        elif style in ("push", "edge"):
            # two messages: "I am in" and "I may still come in"; in the edge form the second marks the loser
            beaten = seen.where(F.col("f_status") == INCLUDED).select("v", F.lit(True).alias("beaten"), F.lit(False).alias("waits"))
            waits = seen.where(F.col("f_status") == UNDECIDED).select("v", F.lit(False).alias("beaten"), F.lit(True).alias("waits"))
            if style == "edge":
                beaten, waits = beaten.distinct(), waits.distinct()
            about = beaten.union(waits).groupBy("v").agg(F.bool_or("beaten").alias("beaten"), F.bool_or("waits").alias("waits"))
        else:
            raise ValueError(f"unknown style {style!r}")
        joined = state.join(about, F.col("id") == F.col("v"), "left")
        new = (
            F.when(F.col("status") != UNDECIDED, F.col("status"))
            .when(F.coalesce("beaten", F.lit(False)), F.lit(EXCLUDED))
            .when(F.coalesce("waits", F.lit(False)), F.lit(UNDECIDED))
            .otherwise(F.lit(INCLUDED))
        )
        before, state = state, cut(joined.select("id", new.alias("status")))
        release(before)
        if state.where(F.col("status") == UNDECIDED).isEmpty():
            release(better)
            return state
    raise DidNotConverge(max_iter)


def mis_data(g: Graph, style: str = "push", mode: str = "u32", max_iter: int = 100_000) -> DataFrame:
    """(id, status) as ``mis``: a worklist of undecided vertices, which shrinks together with the edges between them.

    ``push``: who has no better neighbour left goes in and tells its neighbours; ``pull``: every vertex of the worklist looks at its better
    neighbours; ``edge``: every edge marks its worse end as waiting and, if its better end goes in, as beaten.
    """
    if style not in ("push", "pull", "edge"):
        raise ValueError(f"unknown style {style!r}")
    better, work = cut(better_edges(g, mode)), cut(g.vertices.select("id"))
    decided: list[DataFrame] = []
    for _ in range(max_iter):
        waiting = better.select(F.col("v").alias("b_v")).distinct()
        inside = cut(work.join(waiting, F.col("id") == F.col("b_v"), "left_anti"))
        chosen = inside.select(F.col("id").alias("i_id"))
        if style == "push":
            beaten = better.join(chosen, F.col("w") == F.col("i_id"), "left_semi").select(F.col("v").alias("id")).distinct()
        elif style == "pull":
            looked = better.join(chosen, F.col("w") == F.col("i_id"), "left").groupBy("v").agg(F.bool_or(F.col("i_id").isNotNull()).alias("beaten"))
            beaten = looked.where("beaten").select(F.col("v").alias("id"))
        else:
            marks = better.join(chosen, F.col("w") == F.col("i_id"), "left").select("v", F.when(F.col("i_id").isNotNull(), 2).otherwise(1).alias("mark"))
            beaten = marks.groupBy("v").agg(F.max("mark").alias("mark")).where("mark = 2").select(F.col("v").alias("id"))
        beaten = cut(beaten)
        decided += [inside.select("id", F.lit(INCLUDED).alias("status")), beaten.select("id", F.lit(EXCLUDED).alias("status"))]
        left = cut(work.join(inside.union(beaten), "id", "left_anti"))
        of = lambda end: left.select(F.col("id").alias(f"{end}_id"))
        rest = better.join(of("v"), F.col("v") == F.col("v_id"), "left_semi").join(of("w"), F.col("w") == F.col("w_id"), "left_semi")
        old, work, better = (work, better), left, cut(rest)
        for table in old:
            release(table)
        if work.isEmpty():
            found = decided[0]
            for part in decided[1:]:
                found = found.unionByName(part)
            return found
    raise DidNotConverge(max_iter)


def size_of(status: DataFrame) -> DataFrame:
    """One row: members and their percentage."""
    members = F.count_if(F.col("status") == INCLUDED)
    return status.agg(members.alias("members"), F.round(100.0 * members / F.count(F.lit(1)), 8).alias("percent"))
