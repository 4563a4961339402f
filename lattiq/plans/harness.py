"""Repeat-run timing, median seconds and billions of edges per second; a runner of algorithms over a folder of graphs."""

from __future__ import annotations

import time
from collections.abc import Callable
from statistics import median

from pyspark.sql import DataFrame, SparkSession

from ..operators import mis, mst, pagerank, relax, triangles
from ..sources import csr

#: What the runner can run: name and plan style to a result, for graph and source vertex.
ALGORITHMS: dict[str, Callable] = {
    **{f"bfs_{s}": lambda g, source, s=s: relax.bfs(g, source, s) for s in relax.STYLES},
    **{f"sssp_{s}": lambda g, source, s=s: relax.sssp(g, source, s) for s in relax.STYLES},
    **{f"cc_{s}": lambda g, source, s=s: relax.cc(g, s) for s in relax.STYLES},
    "cc_hook": lambda g, source: relax.cc_hook(g),
    **{f"pr_{s}": lambda g, source, s=s: pagerank.pagerank(g, s)[0] for s in ("push", "pull")},
    "tc_v": lambda g, source: triangles.count_by_vertex(g),
    "tc_e": lambda g, source: triangles.count_by_edge(g),
    **{f"mis_{s}": lambda g, source, s=s: mis.mis(g, s) for s in ("push", "pull", "edge")},
    **{f"mis_data_{s}": lambda g, source, s=s: mis.mis_data(g, s) for s in ("push", "pull", "edge")},
    **{f"mst_{s}_{d}": lambda g, source, s=s, d=d: mst.mst(g, s, d) for s in ("vertex", "edge") for d in ("data", "topo")},
}
RESULT = "graph string, algorithm string, nodes long, edges long, runs int, median_s double, gigaedges_s double, error string"


def measure(run: Callable[[], DataFrame], edges: int, runs: int = 3) -> dict[str, float]:
    """Every run's result is computed whole and thrown away."""
    seconds = []
    for _ in range(runs):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - began)
    middle = median(seconds)
    return {"runs": runs, "median_s": middle, "gigaedges_s": 1e-9 * edges / middle}


def run_folder(spark: SparkSession, folder: str, algorithms: list[str] | None = None, runs: int = 3, source: int = 0, log: str | None = None) -> DataFrame:
    """A row of RESULT per graph file of ``folder`` and algorithm (all without a list), also appended to the table ``log``.  A
    run that fails has its error there and no times, and the others go on."""
    unknown = set(algorithms or ()) - set(ALGORITHMS)
    if unknown:
        raise ValueError(f"unknown algorithms {sorted(unknown)}")
    rows = []
    for name, g in csr.read_folder(spark, folder).items():
        edges = g.edges.count()
        for algorithm in algorithms or ALGORITHMS:
            try:
                found = measure(lambda: ALGORITHMS[algorithm](g, source), edges, runs)  # noqa: B023
                rows.append((name, algorithm, g.n, edges, runs, found["median_s"], found["gigaedges_s"], None))
            except Exception as e:  # reported in the row
                rows.append((name, algorithm, g.n, edges, runs, None, None, f"{type(e).__name__}: {e}"))
    results = spark.createDataFrame(rows, RESULT)
    if log:
        csr.log_results(results, log)
    return results
