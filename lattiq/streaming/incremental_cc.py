"""Spark-only extra: components kept up to date while edges stream in (micro-batches hook old labels together)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.relax import cc
from ..plans.iterate import cut


def merge(labels: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """(id, label) after more pairs(u, v); ids not seen before join in with their own label."""
    ends = pairs.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    seen = ends.select(F.col("u").alias("id")).union(ends.select("v")).distinct()
    if labels is None:
        labels = seen.select("id", F.col("id").alias("label"))
    else:
        new = seen.join(labels, "id", "left_anti").select("id", F.col("id").alias("label"))
        labels = labels.unionByName(new)
    of = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    lifted = ends.join(of("u"), "u").join(of("v"), "v").where("u_label <> v_label").select(F.col("u_label").alias("u"), F.col("v_label").alias("v"))
    tops = labels.select(F.col("label").alias("id")).distinct()
    both = lifted.union(lifted.select(F.col("v"), F.col("u"))).distinct().toDF("src", "dst")
    g = Graph(tops, cut(both.select(F.lit(0).cast("long").alias("eid"), "src", "dst", F.lit(1).cast("long").alias("weight"))), 0)
    new_of = cc(g).select(F.col("id").alias("label"), F.col("label").alias("top"))
    return cut(labels.join(new_of, "label").select("id", F.col("top").alias("label")))
