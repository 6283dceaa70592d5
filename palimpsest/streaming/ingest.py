"""Memories from a stream: validated, deduplicated and appended batch by batch; counts by windows of time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import text as tx
from ..operators import extraction


def _table(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # the first batch makes the table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream's memories (id, content, ...) to the table at ``target``, each content once.

    A batch is deduplicated within itself and against the hashes of what is there, which are kept in a folder beside it
    by their first two digits, so that no batch reads the contents again. A batch that runs again after a failure
    writes over its own folder and passes over its own hashes. Ends when what has arrived is read.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        x = batch.where("content is not null").withColumn("__hash", tx.content_hash(F.col("content"))).withColumn("__part", F.substring("__hash", 1, 2))
        x = x.withColumn("__n", F.row_number().over(Window.partitionBy("__hash").orderBy("id"))).where("__n = 1").drop("__n")
        there = _table(spark, f"{target}_hashes", "hash string, batch long, part string")
        if there is not None:
            # An attempt that ended between the two writes left hashes with this batch's number: its rows are written over.
            old = there.where(F.col("batch") != number)
            x = x.join(old.select(F.col("part").alias("__part"), F.col("hash").alias("__hash")), ["__part", "__hash"], "left_anti")
        x = x.persist()
        try:
            x.select(F.col("__hash").alias("hash"), F.lit(number).cast("long").alias("batch"), F.col("__part").alias("part")).write.mode("append").partitionBy("part").parquet(f"{target}_hashes")
            x.select(batch.columns).write.mode("overwrite").parquet(f"{target}/batch={number}")
        finally:
            x.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, target: str, schema) -> DataFrame:
    """The memories that ``ingest`` has written."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(target)


def upsert(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream's rows to a log at ``target``, a folder for each batch; ``latest`` reads the present state from it.

    Nothing is rewritten, so a batch costs what it brings; one that runs again overwrites its own folder.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log(spark: SparkSession, target: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, version long").option("recursiveFileLookup", "true").parquet(target)


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key: by version, then created_at and id; rows without a key all stay."""
    w = Window.partitionBy(key).orderBy(F.desc("version"), F.desc("created_at"), F.desc("id"))
    keyed = rows.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return keyed.unionByName(rows.where(F.col(key).isNull())).drop("version")


def flush_pending(stream: DataFrame, extractor: Callable, target: str, checkpoint: str) -> StreamingQuery:
    """Runs an extractor over the memories (id, content, speaker) that have arrived since the last call; appends (id, extraction)."""

    def each(batch: DataFrame, number: int) -> None:
        extraction.extracted(batch, extractor).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): tumbling windows over event time; rows later than ``late`` are left out of a stream."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def deduplicated_stream(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each content once while the watermark remembers it."""
    return stream.withColumn("hash", tx.content_hash(F.col("content"))).withWatermark("created_at", late).dropDuplicatesWithinWatermark(["hash"]).drop("hash")
