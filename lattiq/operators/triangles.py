"""Exact triangle counts.  Edges point from the end of lower (degree, id) to the higher one, so a hub has few edges out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, degrees


def _oriented(g: Graph) -> DataFrame:
    rank = degrees(g).select("id", F.struct("degree", "id").alias("rank"))
    of = lambda end: rank.select(F.col("id").alias(end), F.col("rank").alias(f"{end}_rank"))
    ends = g.upper().select("src", "dst").join(of("src"), "src").join(of("dst"), "dst")
    up = F.col("src_rank") < F.col("dst_rank")
    return ends.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))


def count_by_vertex(g: Graph) -> DataFrame:
    """Per edge, the common out-neighbours of its ends."""
    e = _oriented(g)
    lists = e.groupBy("a").agg(F.collect_set("b").alias("out"))
    with_first = e.join(lists, "a").withColumnRenamed("out", "first")
    both = with_first.join(lists.select(F.col("a").alias("b"), F.col("out").alias("second")), "b")
    return both.agg(F.coalesce(F.sum(F.size(F.array_intersect("first", "second"))), F.lit(0)).cast("long").alias("triangles"))


def count_by_edge(g: Graph) -> DataFrame:
    """Wedges over oriented edges, closed by a third edge."""
    e = _oriented(g)
    second = e.select(F.col("a").alias("b"), F.col("b").alias("c"))
    third = e.select("a", F.col("b").alias("c"))
    return e.join(second, "b").join(third, ["a", "c"]).agg(F.count(F.lit(1)).cast("long").alias("triangles"))
