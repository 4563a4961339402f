"""Co-occurrence graphs from the line items: parts or suppliers that large lines of one order share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph

#: table, vertex key, line item key, least quantity (exclusive)
FIXTURES = {
    "part": ("part", "p_partkey", "l_partkey", 40),
    "supp": ("supplier", "s_suppkey", "l_suppkey", 47),
}
_BUILT: dict[tuple[str, str, str], Graph] = {}


def cooccurrence(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    """vertices(id) and pairs(u, v) with u < v."""
    table, key, line_key, least = FIXTURES[name]
    vertices = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("id"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_quantity") > least)
    ends = lines.select("l_orderkey", F.col(line_key).alias("u"))
    other = ends.withColumnRenamed("u", "v")
    return vertices, ends.join(other, "l_orderkey").where("u < v").select("u", "v").distinct()


def graph(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    """The fixture's graph, built once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = Graph.from_pairs(*cooccurrence(spark, sf_dir, name))
    return _BUILT[key]
