from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from lattiq.plans import queries, variants
from lattiq.streaming.incremental_cc import merge

SF = "/root/testdata/sf0.001"
QUICK = ("graph_counts", "hist_in", "bfs_vdl", "sssp_et", "cc_vtl", "tc_v", "pr_pull", "mis_e", "mst_v_topo", "gen_torus", "variants_filter", "variants_sections", "adj_lists", "adj_sorted_check", "pr_residual", "cc_hook", "mis_u64", "mis_u64_mod", "mis_v_data_pull", "gen_rand_grid", "gen_rand_torus", *queries.RANDOM)

#: Queries whose results hang on generated weights.
WIDE = ("sssp_ed", "sssp_vdp", "sssp_vtp", "edge_weight", "sssp_et", "sssp_vdl", "sssp_vtl")


@pytest.mark.parametrize("name", QUICK)
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {Path(f).stem} as select * from '{SF}/{f}'")
    found = queries.queries()[name](spark, SF)
    columns = sorted(found.columns)
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted(str(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert sorted(str(tuple(r)) for r in found.select(*columns).collect()) == expected


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """Tables whose part ids have products beyond 32 bits, on a few orders."""
    folder, con = tmp_path_factory.mktemp("wide"), duckdb.connect()
    con.execute(f"copy (select range as p_partkey from range(100000)) to '{folder}/part.parquet'")
    orders = [(0, 50000), (50000, 99999), (0, 70000), (70000, 99999, 60001), (60001, 90017)]
    lines = ", ".join(f"({i}, {part}, 50.0)" for i, parts in enumerate(orders) for part in parts)
    con.execute(f"copy (select l_orderkey::bigint as l_orderkey, l_partkey::bigint as l_partkey, l_quantity::double as l_quantity from (values {lines}) t(l_orderkey, l_partkey, l_quantity)) to '{folder}/lineitem.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", WIDE)
def test_ids_with_products_beyond_32_bits_match_sql(spark, wide, name):
    con = duckdb.connect()
    for table in ("part", "lineitem"):
        con.execute(f"create view {table} as select * from '{wide}/{table}.parquet'")
    expected = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    rows = sorted(map(str, expected.fetchall()))
    assert sorted(str(tuple(r)) for r in queries.queries()[name](spark, wide).select(*columns).collect()) == rows


def test_every_query_has_an_oracle():
    assert set(queries.queries()) - set(queries.oracle_sql()) == {"mst_part"}  # its SQL form is quadratic; see the next test


def test_spanning_forest_of_the_larger_graph(spark):
    assert queries.queries()["mst_part"](spark, SF).first()[:] == (186, 8484)


def test_filter_language(spark):
    all_ = variants.expand(variants.templates(spark, variants.EXAMPLE)).cache()
    assert variants.summary(all_).first()[:] == (16, 8)
    pick = lambda *lists: variants.select(all_, *lists).count()
    assert pick(["all"], ["all"], ["all"], ["all"]) == 16
    assert pick(["nobug"], ["bfs"], ["all"], ["IntType"]) == 2
    assert pick(["hasbug"], ["all", "~bfs"], ["only_boundsbug"], ["all", "~longtype"]) == 2
    assert pick(["all"], ["all"], ["edge"], ["all"]) == 8
    rules = spark.createDataFrame([("CC_C_E_Topo", ["Block", "IntType"])], "template string, tags array<string>")
    assert variants.suppressed(all_, rules).count() == 14
    text = "/** x **/ CODE: bug: {nobug} pattern: {all, ~pr} option: {only_RaceBug} dataType: {IntType}"
    assert variants.read_configuration(text)["pattern"] == ["all", "~pr"]
    with pytest.raises(ValueError):
        variants.read_configuration("bug: {all}")


def test_sections(spark):
    found = {r.tags: r for r in variants.sections_example(spark).collect()}
    assert len(found) == 6 and not any("Top" in t for t in found)  # 12 less the four with Top and the two that suppress Eager with Low
    assert found["Calm_FieldBug_High"].code == "high();\nrun() {\n  calm();\n  // FieldBug here\n  few();\n\n  // FieldBug here\n  }\n"
    assert found["Eager_NoFieldBug_High"].code == "high();\nrun() {\n  eager();\n  all();\n\n}\n"
    assert found["Calm_NoFieldBug_Low"].code == "low();\nrun() {\n  calm();\n  all();\n\n"
    unused = variants.written(variants.expand(variants.templates(spark, {"A_C_E": "/*@X@*/ declare /*@Y@*/ declare\n/*@+Y@*/\ny\n/*@-Y@*/"})))
    assert [r.tags for r in unused.collect()] == [["Y"]]  # nothing uses X
    with pytest.raises(ValueError):
        variants.body_of("/*@+X@*/\n/*@+Y@*/")


def test_incremental_components(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "u long, v long")
    labels = merge(None, pairs((1, 2), (5, 6)))
    labels = merge(labels, pairs((2, 5), (8, 9)))
    assert {r.id: r.label for r in labels.collect()} == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8}
