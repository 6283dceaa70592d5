"""Intermediate tables: Parquet in the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a session on one machine may go without: it gets a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"  # of an Arrow batch; two of them, and what Python makes of one, are in memory for each task


def settle(spark: SparkSession) -> None:
    """Arrow batches by bytes, not by rows alone, unless the session has its own setting: texts differ in length."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read back.

    Lineage ends here: a lost executor costs the running tasks, not the steps before.
    The files' size is known to the planner, so whether a join with the table is
    broadcast follows from spark.sql.autoBroadcastJoinThreshold. Removed at exit.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/palimpsest-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as it takes for none to be a column of ``df``."""
    have, head = {c.lower() for c in df.columns}, "__"
    while any((head + n).lower() in have for n in names):
        head += "_"
    return [head + n for n in names]


BROADCAST_IDS = 4_000_000  # 8-byte ids, 32 MB; a hash table of them takes about twice that


def only(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids``, a written table.

    Up to BROADCAST_IDS keys are broadcast, so that no other text is shuffled;
    beyond, the join shuffles both sides. The rows are the same.
    """
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, on, "left_semi")


def apart(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key isn't in ``ids``, a written table; sent as in ``only``."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, on, "left_anti")


BROADCAST_GROUPS = 200_000  # rows of a few dozen bytes


def only_few(table: DataFrame) -> DataFrame:
    """A written table of one row a group, broadcast where it is small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table


def clear() -> None:
    """Remove the intermediate tables; whatever still reads them must have ended."""
    while _made:
        spark, path = _made.pop()
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone at exit; the folder belongs to the job
            pass


atexit.register(clear)
