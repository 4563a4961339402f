"""PageRank by Jacobi iteration, without redistribution of the mass of vertices that have no edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, degrees
from ..plans.iterate import cut, release

DAMPING, EPSILON, MAX_ITER = 0.85, 1e-4, 100


def one_step(g: Graph, scores: DataFrame, style: str, damping: float) -> DataFrame:
    """(id, degree, score, change) after one round; ``scores`` has (id, degree, score)."""
    shares = scores.where("degree > 0").select(F.col("id").alias("s_id"), (F.col("score") / F.col("degree")).alias("share"))
    near, far = ("src", "dst") if style == "push" else ("dst", "src")
    gathered = g.edges.join(shares, F.col(near) == F.col("s_id")).groupBy(F.col(far).alias("g_id")).agg(F.sum("share").alias("got"))
    new = F.lit((1 - damping) / max(g.n, 1)) + damping * F.coalesce("got", F.lit(0.0))
    joined = scores.select("id", "degree", "score").join(gathered, F.col("id") == F.col("g_id"), "left")
    return joined.select("id", "degree", new.alias("score"), F.abs(new - F.col("score")).alias("change"))


def pagerank(g: Graph, style: str = "push", damping: float = DAMPING, epsilon: float = EPSILON, max_iter: int = MAX_ITER) -> tuple[DataFrame, int]:
    """((id, degree, score), iterations).  ``push`` sends shares along edges, ``pull`` reads them from
    the edges' targets, which is the same on symmetric graphs."""
    scores = cut(degrees(g).withColumn("score", F.lit(1.0 / max(g.n, 1))))
    for i in range(1, max_iter + 1):
        after = cut(one_step(g, scores, style, damping))
        change = after.agg(F.sum("change")).first()[0] or 0.0
        release(scores)
        scores = after.select("id", "degree", "score")
        scores.lattiq_path = after.lattiq_path
        if change < epsilon:
            return scores, i
    return scores, max_iter


def residual(g: Graph, scores: DataFrame, damping: float = DAMPING) -> DataFrame:
    """One row: the change of one more round, and whether it is below the bound."""
    change = F.sum("change")
    return one_step(g, scores, "push", damping).agg(change.alias("residual"), (change < EPSILON).alias("good"))
