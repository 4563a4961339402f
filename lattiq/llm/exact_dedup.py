"""Exact deduplication by a streaming query with disk-backed keyed state.

1. Every row is landed as (row locator, id, digest of the normalised text); the landing table is the stream, read in several triggers of
   bounded bytes.
2. A streaming aggregation keyed by digest keeps, in RocksDB state that never expires, the smallest
   stable identifier, the locator of its content, and the number of rows.  Later triggers hit the keys that earlier ones left.  Partial
   aggregation runs before the shuffle, so a digest that holds a third of the rows sends one row per task.
3. Full bytes are compared on hits, and of hit rows only: a sieve of their locators picks them from the texts in one scan after the
   last trigger (a scan per trigger would read the table as often as there are triggers).  The smallest and the largest normalised text of a digest
   are the same bytes, or the digest collided and its rows are regrouped by their bytes.

Normalisation replaces each run of ASCII white space by one space.

Defined results: a null text counts as the empty text; of equal texts the row with the smallest id stays
(null ids come last); of repeated rows (same id, same text) exactly one stays; an empty table gives an
empty table; other columns, whatever their names, are not touched.  The locator is the row's file and its number
there; ``docs`` that is no plain Parquet scan is first written as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: State on local disk; files grow as they fill instead of being laid out in advance, and a batch commits its changes only.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Triggers that a landing table takes at least (if it has as many files), and bytes of a trigger at most.
TRIGGERS, TRIGGER_BYTES = 4, 1 << 36
#: Parts in which the texts of a digest are compared.
SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _keeper() -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))


def _bytes_of(spark: SparkSession, path: str) -> int:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def run_stream(spark: SparkSession, landing: str, schema, triggers: int = TRIGGERS) -> DataFrame:
    """The state after the stream over the landing table: (digest, keep, group_size), one row per digest."""
    out, checkpoint = scratch.new_path(spark, "dedup-state"), scratch.new_path(spark, "dedup-checkpoint")
    most = min(TRIGGER_BYTES, max(1, -(-_bytes_of(spark, landing) // triggers)))
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(most))
    state = reader.parquet(landing).groupBy("digest").agg(
        F.min(_keeper()).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_no={number}")  # a replayed batch replaces itself

    with scratch.settings(spark, STATE_STORE):
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(store)
            .start()
        )
        query.awaitTermination()
    fields = "digest string, keep struct<no_id: boolean, id: bigint, row: " + scratch.LOCATOR + ">, group_size bigint"
    try:
        states = spark.read.schema(fields).parquet(out)
        states.schema
    except Exception as e:  # no batch ran: the landing table had no rows
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], fields)
    # a digest is stored once per batch that touched it: the minimum and the count only move one way
    return states.groupBy("digest").agg(F.min("keep").alias("keep"), F.max("group_size").alias("group_size"))


def _collided(docs: DataFrame, joined: DataFrame, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests whose rows are not all the same bytes; ``joined`` has a group's size beside the locator of each of its rows."""
    hits = scratch.sieve(joined.where("group_size > 1").select("row"), F.col("row"))
    rows = docs.select(scratch.locator().alias("row"), F.col(text).alias("raw"))
    found = scratch.sifted(rows, F.col("row"), hits, "hit").where("hit").select("row", normalised(F.col("raw")).alias("norm"))
    found = found.select(digest(F.col("norm")).alias("digest"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"), "norm")
    ends = found.groupBy("digest", "salt").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    whole = ends.groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    return whole.where("least <> most").select("digest")


def exact_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = _sha256,
    triggers: int = TRIGGERS,
) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``."""
    spark, docs = docs.sparkSession, scratch.located(docs)
    norm = normalised(F.col(text))
    texts = docs.select(
        scratch.locator().alias("row"), F.col(key).cast("long").alias("id"), norm.alias("norm")
    ).select("row", "id", "norm", digest(F.col("norm")).alias("digest"))
    if digest is _sha256:
        landed = texts.select("row", "id", "digest", F.col("digest").alias("sha"))
    else:
        landed = texts.select("row", "id", "digest", _sha256(F.col("norm")).alias("sha"))
    path = scratch.new_path(spark, "landing")
    landed.write.parquet(path)
    landed = spark.read.schema(landed.schema).parquet(path)
    states = run_stream(spark, path, landed.schema, triggers)
    states = states.select(F.col("digest").alias("s_digest"), "keep", "group_size")
    joined = scratch.keep(landed.join(states, F.col("digest") == F.col("s_digest")).drop("s_digest"), "joined")
    bad = scratch.keep(_collided(docs, joined, text, digest), "collided")
    if not bad.isEmpty():
        sure = joined.join(bad, "digest", "left_anti")
        split = texts.join(bad, "digest").select("row", "id", "digest", "norm", _sha256(F.col("norm")).alias("sha"))
        split = scratch.keep(split, "split")
        groups = split.groupBy("norm").agg(F.min(_keeper()).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        joined = sure.select("row", "id", "sha", "keep", "group_size").unionByName(
            split.join(groups, "norm").select("row", "id", "sha", "keep", "group_size")
        )
    return joined.select(
        "row",
        F.col("id").alias("doc_id"),
        F.col("keep.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = scratch.located(docs)
    own, kept = scratch.unused(docs, "dedup_row", "dedup_kept_row")
    stays = exact_groups(docs, **options).where("kept").select(F.col("row").alias(kept))
    numbered = docs.select("*", scratch.locator().alias(own))
    return numbered.join(stays, F.col(own) == F.col(kept), "left_semi").drop(own)


def oracle_sql() -> str:
    return r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select *, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size from n)
select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from g"""
