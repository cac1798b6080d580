"""Streams drained to the end give what the same batch query gives."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plexgraph.streaming import changes

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


@pytest.fixture
def folder(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    late = events.agg(F.max("event_id").alias("m")).first().m
    far = events.where(F.col("event_id") == late).withColumn("ts", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")).withColumn("user_id", F.lit(-1).cast("long"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    far.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark past all others
    return str(tmp_path / "in")


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_windows_match_the_batch(spark, folder):
    got = drain(changes.windowed(changes.event_stream(spark, folder), "1 day"), "windows", "complete")
    events = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    want = changes.windowed(events, "1 day")
    key = lambda r: (r.started, r.event_type, r.n, round(r.total, 6))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_bursts_match_the_batch(spark, folder):
    got = drain(changes.debounced(changes.event_stream(spark, folder, 1), "6 hours"), "bursts")
    events = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    want = {tuple(map(str, r)) for r in changes.debounced(events.where("user_id >= 0"), "6 hours").collect()}
    assert {tuple(map(str, r)) for r in got.where("user_id >= 0").collect()} <= want


def test_merging_is_repeatable(spark, tmp_path):
    sink = changes.merge_into(str(tmp_path / "facts"), "k", "at")
    schema = "k long, v string, at long, deleted boolean"
    sink(spark.createDataFrame([(1, "a", 1, False), (2, "b", 1, None), (1, "a2", 2, False)], schema), 0)
    for _ in range(2):
        sink(spark.createDataFrame([(2, None, 3, True), (3, "c", 3, False)], schema), 1)
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "facts/v1")).collect()} == {(1, "a2"), (3, "c")}
