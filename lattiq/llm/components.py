"""Connected components of a link table, by hooking, pointer jumping and contraction.

Every round hooks each vertex to its smallest neighbour (a partial aggregate, so that a hub with
very many links is summed up map-side), jumps pointers to the roots and contracts the links to
roots.  The number of links at least halves in vertices per round; each table is cut from its
lineage in the shared scratch folder.  Nothing is collected but two counts per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that occurs in ``links``; component is the smallest id reachable.

    Self links and repeated links change nothing; rows with a null end are ignored; no link, no row.
    """
    pair = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    pair = pair.where("a is not null and b is not null and a <> b")
    edges = scratch.keep(
        pair.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    labels: DataFrame | None = None
    while True:
        if edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        parent = scratch.keep(parent, "parents")
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("gp"))
            if parent.join(up, "p").where("gp <> p").isEmpty():
                break
            parent = scratch.keep(
                parent.join(up, "p", "left").select("a", F.coalesce("gp", "p").alias("p")), "parents"
            )
        if labels is None:
            labels = parent.select(F.col("a").alias("id"), F.col("p").alias("component"))
        else:
            step = parent.select(F.col("a").alias("component"), "p")
            labels = labels.join(step, "component", "left").select(
                "id", F.coalesce("p", "component").alias("component")
            )
            labels = scratch.keep(labels, "labels")
        of = lambda end: parent.select(F.col("a").alias(end), F.col("p").alias(f"{end}p"))
        contracted = edges.join(of("a"), "a").join(of("b"), "b").where("ap <> bp")
        edges = scratch.keep(
            contracted.select(F.greatest("ap", "bp").alias("a"), F.least("ap", "bp").alias("b")).distinct(), "links"
        )
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
