"""Synthetic undirected graphs as edge tables (src, dst), both directions.

Shapes follow the usual definitions; random ones are seeded and reproducible, but not any other generator's random stream.
Grids, stars, random neighbours and random edges are plans over ``range``; families whose definition is sequential
(trees, bounded degree, planar levels) are built in the driver, which their inputs (a vertex count) bound.
"""

from __future__ import annotations

import random
from collections import deque
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def _local(spark: SparkSession, pairs: set[tuple[int, int]]) -> DataFrame:
    return both_ways(spark.createDataFrame(sorted(pairs), "src long, dst long"))


def shuffled(spark: SparkSession, edges: DataFrame, n: int, seed: int) -> DataFrame:
    """``edges`` with their ids permuted: ranks of a keyed hash."""
    from ..graph import ranked

    ids = ranked(spark.range(n).withColumn("h", F.xxhash64("id", F.lit(seed))), "to", "h", "id").select("id", "to")
    of = lambda end: ids.select(F.col("id").alias(end), F.col("to").alias(f"{end}_to"))
    moved = edges.join(of("src"), "src").join(of("dst"), "dst")
    return moved.select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst"))


def _lattice(spark: SparkSession, dims: int, size: int, wrap: bool) -> DataFrame:
    cells = spark.range(size**dims).withColumn("stride", F.explode(F.array(*[F.lit(size**d).cast("long") for d in range(dims)])))
    at = (F.floor(F.col("id") / F.col("stride")) % size).cast("long")
    step = F.when(at + 1 < size, F.col("stride")).otherwise(F.col("stride") * (1 - size))
    pairs = cells.withColumn("at", at).withColumn("step", step)
    if not wrap:
        pairs = pairs.where(F.col("at") + 1 < size)
    return both_ways(pairs.select(F.col("id").alias("src"), (F.col("id") + F.col("step")).alias("dst")))


def grid(spark: SparkSession, dims: int, size: int) -> DataFrame:
    return _lattice(spark, dims, size, False)


def torus(spark: SparkSession, dims: int, size: int) -> DataFrame:
    """A grid whose ends meet; size 1 gives self loops, size 2 single links."""
    return _lattice(spark, dims, size, True)


def random_grid(spark: SparkSession, dims: int, size: int, seed: int) -> DataFrame:
    return shuffled(spark, grid(spark, dims, size), size**dims, seed)


def random_torus(spark: SparkSession, dims: int, size: int, seed: int) -> DataFrame:
    return shuffled(spark, torus(spark, dims, size), size**dims, seed)


def star(spark: SparkSession, n: int, seed: int = 0, hub: int | None = None) -> DataFrame:
    hub = random.Random(seed).randrange(n) if hub is None else hub
    return both_ways(spark.range(n).where(F.col("id") != hub).select(F.lit(hub).cast("long").alias("src"), F.col("id").alias("dst")))


def all_possible(spark: SparkSession, n: int = 4) -> DataFrame:
    """(graph, src, dst): every undirected graph on n <= 5 vertices; graph g has pair number i if bit i of g is set."""
    if n > 5:
        raise ValueError("at most 5 vertices")
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in range(n) for b in range(a + 1, n))]
    table = spark.createDataFrame(pairs, "bit int, src long, dst long")
    graphs = spark.range(1 << len(pairs)).withColumnRenamed("id", "graph")
    up = graphs.crossJoin(F.broadcast(table)).where(F.call_function("getbit", F.col("graph"), F.col("bit")) == 1).drop("bit")
    return up.union(up.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst")))


def random_neighbour(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """One random neighbour per vertex; chance repeats are one edge."""
    pick = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("long")
    return both_ways(spark.range(n).select(F.col("id").alias("src"), pick.alias("dst")).where("src <> dst"))


def _random_edges(spark: SparkSession, n: int, m: int, end: Column, other: Column, most: float) -> DataFrame:
    if m > most:
        raise ValueError(f"at most {int(most)} edges on {n} vertices")
    tries, seen = 2 * m + 16, None
    for _ in range(12):  # oversample until enough distinct edges are there
        drawn = spark.range(tries).select("id", F.least(end, other).alias("src"), F.greatest(end, other).alias("dst"))
        seen = drawn.where("src <> dst").groupBy("src", "dst").agg(F.min("id").alias("id"))
        if seen.count() >= m:
            break
        tries *= 4
    else:
        raise ValueError(f"these ends do not give {m} distinct edges on {n} vertices")
    return both_ways(seen.orderBy("id").limit(m).select("src", "dst"))


def uniform_degree(spark: SparkSession, n: int, m: int, seed: int) -> DataFrame:
    """m distinct uniform edges."""
    pick = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n)).cast("long")
    return _random_edges(spark, n, m, pick(0), pick(1), n * (n - 1) / 2)


def power_law(spark: SparkSession, n: int, m: int, seed: int) -> DataFrame:
    """m distinct edges with geometrically distributed ends (mean about n / 8)."""
    unit = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
    scale = 1 / log(1 - min(0.5, 8 / max(n, 16)))
    pick = lambda k: F.pmod(F.floor(F.log(unit(k)) * scale), F.lit(n)).cast("long")
    return _random_edges(spark, n, m, pick(0), pick(1), n * n / 3)


def k_max_degree(spark: SparkSession, n: int, k: int, seed: int) -> DataFrame:
    """No vertex gets more than k neighbours: random partners are accepted while both ends have room."""
    rng, degree, pairs = random.Random(seed), [0] * n, set()
    for v in range(n):
        for w in (rng.randrange(n) for _ in range(k // 2)):
            pair = (min(v, w), max(v, w))
            if v != w and pair not in pairs and max(degree[v], degree[w]) < k:
                pairs.add(pair)
                degree[v] += 1
                degree[w] += 1
    return _local(spark, pairs)


def _search_tree(n: int, seed: int) -> list[tuple[int, int, int]]:
    """(parent, child, level) of a search tree over shuffled keys; the neighbour in key order with the later insertion is the parent."""
    keys = list(range(n))
    random.Random(seed).shuffle(keys)
    left, right, level, out = {}, {}, {keys[0]: 0} if n else {}, []
    for key in keys[1:]:
        at = keys[0]
        while True:
            side = left if key < at else right
            if at not in side:
                side[at] = key
                break
            at = side[at]
        level[key] = level[at] + 1
        out.append((at, key, level[key]))
    return out


def binary_tree(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return _local(spark, {(min(a, b), max(a, b)) for a, b, _ in _search_tree(n, seed)})


def binary_forest(spark: SparkSession, n: int, seed: int, p: float = 0.8) -> DataFrame:
    """Vertices in breadth-first order get each of two children with probability p, so that trees may end early."""
    rng, names, pairs, queue, used = random.Random(seed), list(range(n)), set(), deque(), 0
    rng.shuffle(names)
    while used < n:
        if not queue:
            queue.append(used)
            used += 1
        at = queue.popleft()
        for _ in range(2):
            if used < n and rng.random() < p:
                pairs.add((names[at], names[used]))
                queue.append(used)
                used += 1
    return _local(spark, pairs)


def simple_planar(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """A search tree whose consecutive vertices of each level are linked too."""
    tree = _search_tree(n, seed)
    pairs, levels = {(a, b) for a, b, _ in tree}, {}
    for _, child, level in sorted(tree, key=lambda x: (x[2], x[1])):
        if level in levels:
            pairs.add((levels[level], child))
        levels[level] = child
    return _local(spark, {(min(a, b), max(a, b)) for a, b in pairs})


def facts(edges: DataFrame, n: int) -> DataFrame:
    """One row: edges (both directions), vertices with an edge, largest degree, and what a simple undirected graph has none of."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    count = F.count(F.lit(1))
    return (
        edges.agg(
            count.alias("edges"),
            (count - F.count_distinct("src", "dst")).alias("repeats"),
            F.count_if(F.col("src") == F.col("dst")).alias("loops"),
            F.count_if(~F.col("src").between(0, n - 1) | ~F.col("dst").between(0, n - 1)).alias("outside"),
        )
        .crossJoin(edges.join(back, ["src", "dst"], "left_anti").agg(count.alias("one_way")))
        .crossJoin(degrees.agg(count.alias("linked"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree")))
    )  # one row each


def grid_sql(size: int, wrap: bool) -> str:
    """Two-dimensional grid or torus in SQL."""
    right, down = (f"(x + 1) % {size}", f"(y + 1) % {size}") if wrap else ("x + 1", "y + 1")
    limit = "" if wrap else f"where tx < {size} and ty < {size}"
    return f"""with c as (select i % {size} as x, i // {size} as y from range({size * size}) t(i)),
p as (select x + y * {size} as a, tx + ty * {size} as b from (
  select x, y, {right} as tx, y as ty from c union all select x, y, x as tx, {down} as ty from c) {limit})
select distinct cast(src as bigint) as src, cast(dst as bigint) as dst from (select a as src, b as dst from p union all select b, a from p)"""


def all_possible_sql() -> str:
    return """with p(bit, a, b) as (values (0, 0, 1), (1, 0, 2), (2, 0, 3), (3, 1, 2), (4, 1, 3), (5, 2, 3)),
g as (select cast(graph as bigint) as graph, a, b from range(64) t(graph), p where (graph >> bit) & 1 = 1)
select graph, cast(a as bigint) as src, cast(b as bigint) as dst from g union all select graph, cast(b as bigint), cast(a as bigint) from g"""
