"""Binary CSR graph files: int32 node count, edge count, offsets (nodes + 1), neighbours (edges), and an optional block of
int32 edge weights, in host byte order.

Reading is a Python data source that gives each task a range of vertices, of which it reads just the slices of the
three blocks; the path has to be reachable from the executors.  Writing streams the sorted edges through the driver, as the
format is one file with global offsets.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..graph import Graph

INT = 4


class BadFile(ValueError):
    """The file breaks the format."""


def header(path: str) -> tuple[int, int, bool]:
    """(nodes, edges, has weights), checked against the length of the file."""
    size = os.path.getsize(path)
    if size < 2 * INT:
        raise BadFile(f"{path}: no header")
    nodes, edges = (int(x) for x in np.fromfile(path, np.int32, 2))
    if nodes < 1 or edges < 0:
        raise BadFile(f"{path}: {nodes} nodes, {edges} edges")
    bare = INT * (2 + nodes + 1 + edges)
    if size not in (bare, bare + INT * edges):
        raise BadFile(f"{path}: {size} bytes, expected {bare} or {bare + INT * edges}")
    return nodes, edges, edges > 0 and size > bare


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, ranges: int):
        self.path, self.ranges = path, ranges

    def partitions(self) -> list[InputPartition]:
        nodes, _, _ = header(self.path)
        step = -(-nodes // self.ranges)
        return [_Range(at, min(nodes, at + step)) for at in range(0, nodes, step)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        nodes, edges, weighted = header(self.path)

        def ints(at: int, count: int) -> np.ndarray:
            return np.fromfile(self.path, np.int32, count, offset=INT * at)

        offsets = ints(2 + partition.first, partition.last - partition.first + 1).astype(np.int64)
        lo, hi = int(offsets[0]), int(offsets[-1])
        dst = ints(3 + nodes + lo, hi - lo).astype(np.int64)
        src = np.repeat(np.arange(partition.first, partition.last), np.diff(offsets))
        weight = pa.array(ints(3 + nodes + edges + lo, hi - lo).astype(np.int64)) if weighted else pa.nulls(hi - lo, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(lo, hi)), pa.array(src), pa.array(dst), weight], names=["eid", "src", "dst", "weight"]
        )


class CsrSource(DataSource):
    """spark.read.format("csr").option("ranges", n).load(path): (eid, src, dst, weight)."""

    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return "eid long, src long, dst long, weight long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].removeprefix("file://"), int(self.options.get("ranges", "8")))


def read(spark: SparkSession, path: str, ranges: int = 8) -> Graph:
    """The graph of a file; weights are null where the file has none."""
    from ..session import ship_code

    ship_code(spark)
    spark.dataSource.register(CsrSource)
    nodes, _, _ = header(path.removeprefix("file://"))
    edges = spark.read.format("csr").option("ranges", str(ranges)).load(path)
    return Graph(spark.range(nodes), edges, nodes)


def read_folder(spark: SparkSession, folder: str) -> dict[str, Graph]:
    """Every file of a folder that is a graph."""
    return {name: read(spark, os.path.join(folder, name)) for name in sorted(os.listdir(folder)) if name.endswith(".egr")}


def write(g: Graph, path: str, weights: bool = True) -> None:
    """Write a graph; edges go out sorted by (src, dst).  The format holds less than 2**31 of them."""
    degrees = g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    offsets = np.zeros(g.n + 1, np.int64)
    for row in degrees.toLocalIterator():
        offsets[row.src + 1] = row.n
    np.cumsum(offsets, out=offsets)
    edges = int(offsets[-1])
    if max(edges, g.n) >= 2**31:
        raise OverflowError(f"{g.n} vertices and {edges} edges do not fit the format")
    with open(path, "wb") as out:
        np.array([g.n, edges], np.int32).tofile(out)
        offsets.astype(np.int32).tofile(out)
        blocks = [np.empty(edges, np.int32), np.empty(edges, np.int32)]
        for i, row in enumerate(g.edges.orderBy("src", "dst").select("dst", "weight").toLocalIterator()):
            blocks[0][i], blocks[1][i] = row.dst, row.weight or 0
        for block in blocks[: 1 + weights]:
            block.tofile(out)


def log_results(results: DataFrame, path: str) -> None:
    """Append result rows to a table of runs."""
    results.write.mode("append").parquet(path)
