"""Shared scratch tables: lineage is cut by writing a Parquet table that every executor can read.

The folder is the cluster's ``spark.checkpoint.dir``; only a session that names none (tests, a
laptop) gets one of its own.  Tables outlive the executors that wrote them, so a lost executor
costs at most the tasks it was running.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = uuid.uuid4().hex[:12]
_ROOTS: set[str] = set()


def root(spark: SparkSession) -> str:
    """This run's folder below the shared checkpoint folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="lattiq-")
        spark.conf.set("spark.checkpoint.dir", shared)
    base = f"{shared.rstrip('/')}/lattiq-{_RUN}"
    if base not in _ROOTS:
        _ROOTS.add(base)
        atexit.register(_remove, spark, base)
    return base


def _remove(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the session may have ended before the interpreter does
        return


def new_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex[:10]}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table whose readers are done."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def keep(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder, with a folder per value of ``folders``, and read it from there from now on."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the jobs inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Type of a row's locator: a hash of its file's path, and its number in that file.
LOCATOR = "struct<file: bigint, at: bigint>"


def located(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a plain Parquet scan, else its rows as a table in the scratch folder: rows that ``locator``
    can tell apart."""
    plain = df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation"
    if plain and "row_index" in df.select("_metadata").schema["_metadata"].dataType.names:
        return df
    return keep(df, "rows")


def locator() -> Column:
    """The same for a row in every scan, however the files are split: splits follow the number of cores, and so change
    when executors are lost."""
    return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


#: Bits of a sieve: 16 MB, whatever the number of keys.
SIEVE_BITS = 1 << 27


def sieve(keys: DataFrame, key: Column) -> DataFrame:
    """A bitmap of the hashes of ``key``, in at most 4096 buckets of 4 KB each."""
    bit = keys.select((F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS)) + 1).alias("bit"))
    bitmap = F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("sieve_bits")
    return keep(bit.groupBy(F.bitmap_bucket_number("bit").alias("sieve_bucket")).agg(bitmap), "sieve")


def sifted(rows: DataFrame, key: Column, bitmap: DataFrame, into: str) -> DataFrame:
    """``rows`` with the flag ``into``: false only where ``key`` is surely none of the sieve's."""
    at = F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS)) + 1
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("sieve_bits"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    marked = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(at) == F.col("sieve_bucket"), "left")
    return marked.withColumn(into, F.coalesce(hit, F.lit(False))).drop("sieve_bucket", "sieve_bits")


#: Bytes of a slice, if it has more than one row.
SLICE_BYTES = 1 << 23


def pieces_of(batches, rows: int = 512, most: int = SLICE_BYTES):
    """Arrow batches cut into slices of few rows and few bytes (a single row may be longer), so that a worker's memory stays bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            todo = [batch.slice(at, rows)]
            while todo:
                part = todo.pop()
                if part.nbytes > most and part.num_rows > 1:
                    half = part.num_rows // 2
                    todo += [part.slice(half), part.slice(0, half)]
                else:
                    yield part
