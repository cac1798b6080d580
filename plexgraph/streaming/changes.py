"""Structured Streaming forms of the watcher, the incremental merge and windowed counts.

Event time must be a timestamp with a zone, so zoneless ones are cast in a session that runs in UTC.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """The events that arrive as Parquet files in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def debounced(events: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Bursts of changes of a user with no gap: when they start and end, how many events, which kinds."""
    bursts = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return bursts.agg(F.count("*").alias("events"), F.array_sort(F.collect_set("event_type")).alias("files")).select("user_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "events", "files")


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by kind in tumbling or sliding windows (a Spark extension)."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("started"), "event_type", "n", "total")


def merge_facts(base: DataFrame, fresh: DataFrame, key: str, order: str) -> DataFrame:
    """Facts kept, with the latest fresh fact of a key in their place; a fresh fact marked ``deleted`` removes its key."""
    latest = fresh.groupBy(key).agg(F.max_by(F.struct(*fresh.columns), order).alias("r")).select("r.*")
    return base.join(latest.select(key), key, "left_anti").unionByName(latest.where(~F.coalesce("deleted", F.lit(False))).select(*base.columns))


def merge_into(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that merges batches into versioned Parquet snapshots under ``path``.

    A batch reads the snapshot before it and writes its own, so a batch that is run again gives the same snapshot.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = [c for c in batch.columns if c != "deleted"]
        base = spark.read.parquet(f"{path}/v{number - 1}") if number else batch.where("false").select(*kept)
        merge_facts(base, batch, key, order).write.mode("overwrite").parquet(f"{path}/v{number}")

    return sink
