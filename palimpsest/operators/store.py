"""Keys, filters, ranges and changes of the memory table."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidFilter, NotConfigured
from ..functions import text as tx

OPS = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
}


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, with its lineage cut: a checkpoint in the folder that spark.checkpoint.dir names.

    Lost executors cost running tasks, not the steps before, and what several later steps use isn't planned again
    in each. Only a session on one machine may go without that setting.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise NotConfigured("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="palimpsest-"))
    return df.checkpoint()


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970; times without a zone count as UTC, whatever the session's zone."""
    if df.schema[column].dataType.simpleString() == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column))
    return F.unix_micros(column)


def ranked(df: DataFrame, at: str) -> DataFrame:
    """``df`` with its place by falling ``at`` and rising id (rank, from 1), and the number of rows (n).

    Hours are counted and summed up, rows ranked within their hour: no task sorts the whole table.
    """
    x = df.withColumn("__hour", F.date_trunc("hour", at))
    hours = x.groupBy("__hour").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy(F.desc_nulls_last("__hour")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = hours.select("__hour", before.alias("__before"), F.sum("__c").over(Window.partitionBy()).alias("n"))  # a row an hour
    place = F.row_number().over(Window.partitionBy("__hour").orderBy(F.desc(at), "id"))
    return x.withColumn("__r", place).join(offset.withColumnRenamed("__hour", "__h"), F.col("__hour").eqNullSafe(F.col("__h"))).select(*df.columns, (F.col("__before") + F.col("__r")).alias("rank"), "n")


def condition(f: dict) -> Column:
    """One filter, as {field, op, value} or {field, op: in, values}: strings compared byte by byte, a missing field never fits."""
    c = F.col("metadata")[f["field"]]
    if f["op"] == "in":
        got = c.isin([str(v) for v in f["values"]])
    elif f["op"] in OPS:
        got = OPS[f["op"]](c, F.lit(str(f["value"])))
    else:
        raise InvalidFilter(f"unknown filter operation: {f['op']}")
    return F.coalesce(got, F.lit(False))


def filtered(memories: DataFrame, filters: list[dict] | None = None, namespace: str | None = None) -> DataFrame:
    """The memories that fit all filters; ahead of any scoring, so that the scan prunes."""
    if namespace is not None:
        memories = memories.where(F.col("namespace") == namespace)
    return memories.where(reduce(Column.__and__, map(condition, filters))) if filters else memories


def deduplicated(memories: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New memories whose exact content is neither stored nor earlier in the batch."""
    x = memories.withColumn("h", tx.content_hash(F.col("content")))
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where("n = 1").drop("n")
    if existing is not None:
        x = x.join(existing.select(tx.content_hash(F.col("content")).alias("h")).distinct(), "h", "left_anti")
    return x.select(memories.columns)


def upserted(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``existing`` with those of the same key replaced by the latest new one."""
    w = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id"))
    last = new.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return existing.join(last.select(key), key, "left_anti").select(existing.columns).unionByName(last.select(existing.columns))


def checked(batch: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose embedding has ``dim`` numbers, and the others with what is wrong."""
    n = F.coalesce(F.size("embedding"), F.lit(-1))
    return batch.where(n == dim), batch.where(n != dim).withColumn("error", F.format_string(f"embedding has %d numbers, not {dim}", n))


def without(memories: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return memories.join(gone.select(key), key, "left_anti").select(memories.columns)


def with_embeddings(memories: DataFrame, new: DataFrame) -> DataFrame:
    """Embeddings replaced where ``new`` (id, embedding) has one."""
    n = new.select("id", F.col("embedding").alias("__e"))
    return memories.join(n, "id", "left").withColumn("embedding", F.coalesce("__e", "embedding")).select(memories.columns)


def in_range(memories: DataFrame, start, end, limit: int | None = None) -> DataFrame:
    """Memories from start to end, both included: of the oldest ``limit`` ones, the newest first (column rank)."""
    x = memories.where(F.col("created_at").between(start, end))
    if limit is None:
        neg = x.withColumn("__id", F.col("id")).withColumn("id", -F.col("id"))
        return ranked(neg, "created_at").drop("n").withColumn("id", F.col("__id")).drop("__id").withColumn("rank", F.col("rank").cast("int"))
    x = x.orderBy("created_at", "id").limit(limit)
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))))


def recent(memories: DataFrame, n: int) -> DataFrame:
    """The newest n."""
    x = memories.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))))


def range_scores(memories: DataFrame, start, end, limit: int) -> DataFrame:
    """(id, score, rank): position scores from 1 for the newest down."""
    x = in_range(memories, start, end, limit)
    return x.select("id", "rank", F.when(F.lit(limit > 1), 1 - (F.col("rank") - 1) / F.lit(max(limit - 1, 1))).otherwise(1.0).alias("score"))
