"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from . import embedding_dedup, exact_dedup, language_id, mixing, ngram_join, packing, quality, secret_scan, sharding, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_table(spark, sf_dir, "documents"), n=4, threshold=ngram_join.Threshold(85, 100))


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).drop("row")


def op7_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=16)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("row")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs), spans=True)
    named = F.transform("spans", lambda s: F.concat_ws(":", s["lang"], s["start"], s["end"]))
    return found.withColumn("spans", F.array_join(named, ","))


OPERATORS = (
    op1_best_fit_packing, op2_ngram_jaccard_join, op3_warc_salvage, op4_embedding_near_dedup, op5_secret_linking,
    op6_exact_dedup, op7_feistel_sharding, op8_quality_classifier, op9_source_mixing, op10_language_id,
)


def with_code(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after its workers can import this package."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session.ship_code(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: with_code(f) for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": ngram_join.oracle_sql(4, ngram_join.Threshold(85, 100)),
        "op3_warc_salvage": warc.oracle_sql(),
        "op4_embedding_near_dedup": embedding_dedup.oracle_sql(0.95),
        "op6_exact_dedup": exact_dedup.oracle_sql(),
        "op7_feistel_sharding": sharding.oracle_sql(),
    }
