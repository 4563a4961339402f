"""Registered graph queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import graph as G
from ..functions.hashing import mis_priority
from ..operators import mis, mst, pagerank, relax, triangles
from ..sources import generators
from ..sources.fixtures import FIXTURES, graph
from . import variants

Query = Callable[[SparkSession, str], DataFrame]
SOURCE = 0
DATA_DRIVEN = {"mis_v_data_push": "push", "mis_v_data_pull": "pull", "mis_e_data": "edge"}


def _on(name: str, f: Callable[[G.Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(graph(spark, sf_dir, name))


FAULTS = ("repeats", "loops", "outside", "one_way")
SIMPLE = {name: 0 for name in FAULTS}


def _of_kind(graph_edges: DataFrame, n: int, /, **checks: str) -> DataFrame:
    """The faults of a generated graph (all 0 in a simple undirected one) and the named expressions over its facts; ``parts``
    is its number of components."""
    found = generators.facts(graph_edges, n)
    if any("parts" in c for c in checks.values()):
        g = G.Graph.from_pairs(graph_edges.sparkSession.range(n), graph_edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
        found = found.crossJoin(relax.component_count(relax.cc_hook(g)).withColumnRenamed("components", "parts"))  # one row each
    return found.select(*FAULTS, *[F.expr(c).alias(name) for name, c in checks.items()])


def _lattice_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").count().groupBy(F.col("count").alias("degree")).agg(F.count(F.lit(1)).alias("vertices"))


#: Random generators: the query, and the values that its row must have.
RANDOM = {
    "gen_rand_neighbor": (lambda s: _of_kind(generators.random_neighbour(s, 300, 5), 300, in_bounds="edges between 300 and 600"), {"in_bounds": True}),
    "gen_uniform_degree": (lambda s: _of_kind(generators.uniform_degree(s, 200, 900, 5), 200, edges="edges"), {"edges": 1800}),
    "gen_power_law": (lambda s: _of_kind(generators.power_law(s, 200, 700, 5), 200, edges="edges", low_ids="linked < 160"), {"edges": 1400, "low_ids": True}),
    "gen_binary_tree": (lambda s: _of_kind(generators.binary_tree(s, 150, 5), 150, edges="edges", parts="parts", narrow="max_degree <= 3"), {"edges": 298, "parts": 1, "narrow": True}),
    "gen_binary_forest": (lambda s: _of_kind(generators.binary_forest(s, 150, 5), 150, cycles="edges div 2 + parts - 150", narrow="max_degree <= 3"), {"cycles": 0, "narrow": True}),
    "gen_simple_planar": (lambda s: _of_kind(generators.simple_planar(s, 150, 5), 150, parts="parts", sparse="edges div 2 between 149 and 3 * 150 - 6"), {"parts": 1, "sparse": True}),
    "gen_k_max_degree": (lambda s: _of_kind(generators.k_max_degree(s, 150, 6, 5), 150, narrow="max_degree <= 6", linked="linked > 75"), {"narrow": True, "linked": True}),
}


def _graph_queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "graph_counts": _on("part", G.counts),
        "degree_out": _on("part", G.degrees),
        "hist_in": _on("part", lambda g: G.histogram(g, "in")),
        "hist_out": _on("part", lambda g: G.histogram(g, "out")),
        "max_degree": _on("part", lambda g: G.degrees(g).agg(F.max("degree").alias("max_degree"))),
        "edge_sp": _on("part", lambda g: g.edges.select("eid", "src", "dst")),
        "edge_weight": _on("part", lambda g: g.edges.select("src", "dst", "weight")),
        "adj_lists": _on("part", lambda g: g.adjacency().select("id", F.array_join(F.transform("nbrs", lambda v: v.cast("string")), ",").alias("nbrs"))),
        "adj_sorted_check": _on("part", lambda g: G.is_sorted(g.adjacency())),
        "symmetric_check": _on("part", lambda g: G.is_symmetric(g.edges)),
        "mis_priority": _on("part", lambda g: g.vertices.select("id", mis_priority(F.col("id")).alias("u32"), mis_priority(F.col("id"), "s32").alias("s32"), mis_priority(F.col("id"), "u32_mod1000").alias("mod1000"))),
        "bfs_farthest": _on("part", lambda g: relax.farthest(relax.bfs(g, SOURCE))),
        "sssp_farthest": _on("part", lambda g: relax.farthest(relax.sssp(g, SOURCE))),
        "cc_count": _on("part", lambda g: relax.component_count(relax.cc(g))),
        "tc_v": _on("part", triangles.count_by_vertex),
        "tc_e": _on("part", triangles.count_by_edge),
        "pr_residual": _on("part", lambda g: pagerank.residual(g, pagerank.pagerank(g)[0]).select(F.round("residual", 9).alias("residual"), "good")),
        "cc_hook": _on("part", relax.cc_hook),
        "mis_size": _on("part", lambda g: mis.size_of(mis.mis(g))),
        "mis_s32": _on("part", lambda g: mis.mis(g, mode="s32")),
        "mis_mod1000": _on("part", lambda g: mis.mis(g, mode="u32_mod1000")),
        "mis_u64": _on("part", lambda g: mis.mis(g, mode="u64")),
        "mis_u64_mod": _on("part", lambda g: mis.mis(g, mode="u64_mod")),
        "mst_v": _on("supp", lambda g: mst.mst(g, "vertex")),
        "mst_e": _on("supp", lambda g: mst.mst(g, "edge")),
        "mst_v_topo": _on("supp", lambda g: mst.mst(g, "vertex", "topo")),
        "mst_e_topo": _on("supp", lambda g: mst.mst(g, "edge", "topo")),
        "mst_part": _on("part", lambda g: mst.total(mst.mst(g))),
        "mst_total": _on("supp", lambda g: mst.total(mst.mst(g))),
    }
    for style in relax.STYLES:
        found[f"bfs_{style}"] = _on("part", lambda g, s=style: relax.bfs(g, SOURCE, s))
        found[f"sssp_{style}"] = _on("part", lambda g, s=style: relax.sssp(g, SOURCE, s))
        found[f"cc_{style}"] = _on("part", lambda g, s=style: relax.cc(g, s))
    for style in ("push", "pull"):
        found[f"pr_{style}"] = _on("part", lambda g, s=style: pagerank.pagerank(g, s)[0].select("id", F.round("score", 8).alias("score")))
    for name, style in (("mis_v_push", "push"), ("mis_v_pull", "pull"), ("mis_e", "edge")):
        found[name] = _on("part", lambda g, s=style: mis.mis(g, s))
    for name, style in DATA_DRIVEN.items():
        found[name] = _on("part", lambda g, s=style: mis.mis_data(g, s))
    found |= {
        "gen_grid": lambda spark, _: generators.grid(spark, 2, 7),
        "gen_torus": lambda spark, _: generators.torus(spark, 2, 5),
        "gen_rand_grid": lambda spark, _: _lattice_degrees(generators.random_grid(spark, 2, 9, 5)),
        "gen_rand_torus": lambda spark, _: _lattice_degrees(generators.random_torus(spark, 2, 6, 5)),
        "gen_star": lambda spark, _: generators.star(spark, 50, hub=3),
        "gen_all_possible": lambda spark, _: generators.all_possible(spark, 4),
        "variants_filter": lambda spark, _: variants.example(spark),
        "variants_sections": lambda spark, _: variants.sections_example(spark),
    }
    found |= {name: lambda spark, _, f=f: f(spark) for name, (f, _) in RANDOM.items()}
    return found


def queries() -> dict[str, Query]:
    return _graph_queries()


def _prefix(name: str) -> str:
    table, key, line, least = FIXTURES[name]
    return f"""with recursive V(v) as (select {key} from {table}),
U(u, v) as (select distinct a.{line}, b.{line} from lineitem a join lineitem b using (l_orderkey)
  where a.{line} < b.{line} and a.l_quantity > {least} and b.l_quantity > {least}),
E(u, v) as (select u, v from U union all select v, u from U),
N(n) as (select count(*) from V),
W(u, v, w, eid) as (select u, v, abs(1 + (u * v) % n), row_number() over (order by u, v) - 1 from E, N),
D(u, deg) as (select V.v, count(E.u) from V left join E on E.u = V.v group by 1)"""


def _hash(x: str) -> str:
    for _ in range(2):
        x = f"((xor(({x}) >> 16, {x}) * 73244475) & 4294967295)"
    return f"xor(({x}) >> 16, {x})"


def _relaxed(value: str, start: str, weight: str) -> str:
    return f"""{_prefix("part")},
b(v, d) using key (v) as ({start} union
  select e.v, min(b.d + {weight}) from b join W e on e.u = b.v left join recurring.b r on r.v = e.v
  group by e.v having min(b.d + {weight}) < min(coalesce(r.d, 1000000000000))),
S as (select V.v as id, cast(b.d as bigint) as {value} from V left join b using (v))"""


def _mis(priority: str) -> str:
    return f"""{_prefix("part")},
P(v, p) as (select v, {priority} from (select v, {_hash("v + 712313887")} as h, {_hash("v + 683067839")} as h2 from V)),
HI(u, v) as (select E.u, E.v from E join P a on a.v = E.u join P b on b.v = E.v where (b.p, b.v) > (a.p, a.v)),
m(i, v, st) as (select 0, v, 0 from V union all select i + 1, v,
  case when st <> 0 then st when inc then 2 when nund then 0 else 1 end from (
  select m.i, m.v, m.st, coalesce(q.inc, false) inc, coalesce(q.nund, false) nund from m left join
  (select HI.u, bool_or(m2.st = 1) inc, bool_or(m2.st = 0) nund from HI join m m2 on m2.v = HI.v group by 1) q on q.u = m.v)
  where (select count(*) from m where st = 0) > 0),
S as (select v as id, cast(st as integer) as status from m where i = (select max(i) from m))"""


def oracle_sql() -> dict[str, str]:
    base = _prefix("part")
    source = f"select {SOURCE}, 0"
    bfs, sssp = _relaxed("dist", source, "1"), _relaxed("dist", source, "e.w")
    cc = _relaxed("label", "select v, v from V", "0")
    degree = "select u as id, cast(deg as bigint) as degree from D"
    histogram = f"{base} select cast(deg as bigint) as degree, count(*) as vertices from D group by 1"
    farthest = "select min(id) as id, max(d) as dist from (select id, coalesce(dist, 2147483647) d, max(coalesce(dist, 2147483647)) over () m from S) where d = m"
    hashed = _hash("v + 712313887")
    signed = lambda h: f"case when {h} >= 2147483648 then {h} - 4294967296 else {h} end"
    rank = f"""{base},
p(i, v, s, err) as (select 0, v, 1.0::double / n, null::double from V, N union all
  select i + 1, v, ns, sum(abs(ns - s)) over () from (select p.i, p.v, p.s, 0.15::double / n + 0.85::double * coalesce(q.x, 0) ns
    from p cross join N left join (select E.v v, sum(p2.s / D.deg) x from p p2 join D on D.u = p2.v join E on E.u = p2.v group by 1) q on q.v = p.v
    where p.i < 100 and (p.err is null or p.err >= 0.0001))),
S as (select * from p where i = (select max(i) from p))"""
    forest = f"""{_prefix("supp")},
K as (select u, v, w * 1000000 + least(eid, (select eid from W w2 where w2.u = W.v and w2.v = W.u)) k from W),
mm(s, t, k) using key (s, t) as (select u, v, k from K union
  select mm.s, e.v, min(greatest(mm.k, e.k)) from mm join K e on e.u = mm.t
  left join recurring.mm r on r.s = mm.s and r.t = e.v where e.v <> mm.s group by 1, 2
  having min(greatest(mm.k, e.k)) < min(coalesce(r.k, 1000000000000000))),
S as (select W.eid, W.u as src, W.v as dst, W.w as weight from W join mm on mm.s = W.u and mm.t = W.v join K on K.u = W.u and K.v = W.v
      where W.u < W.v and mm.k = K.k)"""
    forest_rows = f"{forest} select cast(eid as bigint) eid, src, dst, cast(weight as bigint) as weight from S"
    tri = f"{base} select count(*) as triangles from U a join U b on a.v = b.u join U c on c.u = a.u and c.v = b.v"
    found = {
        "graph_counts": f"{base} select count(*) as nodes, cast(sum(deg) as bigint) as edges, round(avg(deg), 8) as avg_degree, cast(max(deg) as bigint) as max_degree from D",
        "degree_out": f"{base} {degree}",
        "hist_in": histogram,
        "hist_out": histogram,
        "max_degree": f"{base} select cast(max(deg) as bigint) as max_degree from D",
        "edge_sp": f"{base} select cast(eid as bigint) as eid, u as src, v as dst from W",
        "edge_weight": f"{base} select u as src, v as dst, cast(w as bigint) as weight from W",
        "adj_lists": f"{base} select u as id, string_agg(cast(v as varchar), ',' order by v) as nbrs from E group by 1",
        "adj_sorted_check": f"{base}, L as (select u, list(v order by eid) as l from W group by 1) select coalesce(bool_and(l = list_sort(list_distinct(l))), true) as sorted from L",
        "symmetric_check": f"{base} select count(*) = 0 as symmetric from E a left join E b on a.u = b.v and a.v = b.u where b.u is null",
        "mis_priority": f"{base} select v as id, {hashed} as u32, {signed(f'({hashed})')} as s32, ({hashed}) % 1000 as mod1000 from V",
        "bfs_farthest": f"{bfs} {farthest}",
        "sssp_farthest": f"{sssp} {farthest}",
        "cc_count": f"{cc} select count(distinct label) as components from S",
        "tc_v": tri,
        "tc_e": tri,
        "pr_residual": f"""{rank},
R as (select S.v, abs(0.15::double / n + 0.85::double * coalesce(q.x, 0) - S.s) as d from S cross join N left join
  (select E.v v, sum(S.s / D.deg) x from S join D on D.u = S.v join E on E.u = S.v group by 1) q on q.v = S.v)
select round(sum(d), 9) as residual, sum(d) < 0.0001 as good from R""",
        "cc_hook": f"{cc} select id, label from S",
        "mis_u64": f"{_mis('cast(h2 as hugeint) * 4294967296 + h')} select * from S",
        "mis_u64_mod": f"{_mis('h | ((h2 % 1000) * 296 % 1000)')} select * from S",
        "mst_v_topo": forest_rows,
        "mst_e_topo": forest_rows,
        "mis_size": f"{_mis('h')} select count(*) filter (status = 1) as members, round(100.0::double * count(*) filter (status = 1) / count(*), 8) as percent from S",
        "mis_s32": f"{_mis(signed('h'))} select * from S",
        "mis_mod1000": f"{_mis('h % 1000')} select * from S",
        "mst_v": forest_rows,
        "mst_e": forest_rows,
        "mst_total": f"{forest} select count(*) as edges, cast(sum(weight) as bigint) as weight from S",
        "gen_grid": generators.grid_sql(7, False),
        "gen_torus": generators.grid_sql(5, True),
        "gen_rand_grid": f"select degree, count(*) as vertices from (select src, count(*) as degree from ({generators.grid_sql(9, False)}) group by 1) group by 1",
        "gen_rand_torus": f"select degree, count(*) as vertices from (select src, count(*) as degree from ({generators.grid_sql(6, True)}) group by 1) group by 1",
        "gen_star": "select cast(case when d then 3 else i end as bigint) as src, cast(case when d then i else 3 end as bigint) as dst from range(50) t(i), (values (true), (false)) s(d) where i <> 3",
        "gen_all_possible": generators.all_possible_sql(),
        "variants_filter": variants.EXAMPLE_SQL,
        "variants_sections": variants.SECTIONS_SQL,
    }
    for style in relax.STYLES:
        found[f"bfs_{style}"] = f"{bfs} select id, dist from S"
        found[f"sssp_{style}"] = f"{sssp} select id, dist from S"
        found[f"cc_{style}"] = f"{cc} select id, label from S"
    for style in ("push", "pull"):
        found[f"pr_{style}"] = f"{rank} select v as id, round(s, 8) as score from S"
    for name, (_, values) in RANDOM.items():
        literal = lambda v: str(v).lower() if isinstance(v, bool) else f"cast({v} as bigint)"
        found[name] = "select " + ", ".join(f"{literal(v)} as {c}" for c, v in (SIMPLE | values).items())
    for name in ("mis_v_push", "mis_v_pull", "mis_e", *DATA_DRIVEN):
        found[name] = f"{_mis('h')} select * from S"
    return found
