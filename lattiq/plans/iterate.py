"""Driver-side loops over DataFrames: each round's state is written to the shared checkpoint folder, so plans stay short
and a lost executor costs its running tasks only.  A loop deletes a round's tables when the next round's are written; the rest go when the
application ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


_RUN = uuid.uuid4().hex[:12]
_SEEN: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This run's folder below the shared checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lattiq-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/lattiq-loop-{_RUN}"
    if path not in _SEEN:
        _SEEN.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before the interpreter does
        return


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and without lineage."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.lattiq_path = path
    return found


def release(df: DataFrame) -> None:
    """Delete a table that ``cut`` wrote, once its readers are done; other DataFrames are left alone."""
    path = df.__dict__.get("lattiq_path")
    if path:
        _remove(df.sparkSession, path)


class DidNotConverge(RuntimeError):
    """The loop reached its bound; ``rounds`` says how many it ran."""

    def __init__(self, rounds: int):
        super().__init__(f"no fixpoint after {rounds} rounds")
        self.rounds = rounds


def until_unchanged(state: DataFrame, step: Callable[[DataFrame], DataFrame], max_iter: int, flag: str = "changed") -> DataFrame:
    """Repeat ``step`` (which marks changed rows in ``flag``) until no row changes."""
    for _ in range(max_iter):
        before, state = state, cut(step(state))
        release(before)
        if state.where(flag).isEmpty():
            return state
    raise DidNotConverge(max_iter)
