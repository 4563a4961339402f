"""The pipeline against a step-by-step brute force, and on an empty table."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from lattiq.llm import mixing, packing, queries
from test_operators import SCHEMA, brute_components, edge_rows, norm, shingles, table, words_of

LABELS = "doc_id long, quality int, toxic int"


def folder(spark, tmp_path, rows, labels):
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = [r for r in edge_rows() if r[0] not in (19, None)]
    sf_dir = folder(spark, tmp_path, rows, [(i, 1, 0) for i in range(10)])  # one class only: nothing is rejected
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == spark.read.parquet(f"{sf_dir}/documents.parquet").columns
        path = str(tmp_path / f"stage{len(stages)}")
        docs.write.parquet(path)
        docs = spark.read.schema(SCHEMA).parquet(path)
        stages.append(docs.collect())
    assert len(stages[0]) == len(rows)
    first = {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        first.setdefault(norm(t), i)
    assert sorted(r.doc_id for r in stages[1]) == sorted(first.values())
    component = brute_components({r.doc_id: shingles(r.text, 5) for r in stages[1]}, 80, 100)
    assert sorted(r.doc_id for r in stages[2]) == sorted(i for i, c in component.items() if i == c)
    taken = {r.doc_id: r.copies for r in mixing.mix(spark.read.schema(SCHEMA).parquet(str(tmp_path / "stage2"))).collect()}
    copies = Counter(r.doc_id for r in stages[3])
    assert copies == Counter({i: n for i, n in taken.items() if n})
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    encoder, expected = packing.Encoder(), 0
    for r in stages[3]:
        expected += len(encoder(r.text or "")) + 1
    assert sum(r.length for r in packed) == expected and {r.doc_id for r in packed} == set(copies)
    assert sum(len(words_of(r.text)) for r in stages[3]) > 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_query_runs(spark):
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
