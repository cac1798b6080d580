"""Interval joins by buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlaps(hunks: DataFrame, spans: DataFrame, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``hunks`` (lo, hi) and ``spans`` (start, end; null: open) with equal ``keys`` that overlap, each pair once.

    Both sides go to every bucket of ``width`` that they touch and a pair is kept in the first one it shares. An open span is
    cut at the last hunk's end, so no row goes to more buckets than hunks can reach.
    """
    last = F.broadcast(hunks.agg(F.max("hi").alias("_last")))  # one row
    h = hunks.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    s = spans.join(last).where(F.col("_last") >= F.col("start"))
    s = s.withColumn("_e", F.least(F.coalesce("end", "_last"), "_last")).where(F.col("_e") >= F.col("start"))
    s = s.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("_e") / width))))
    first = F.col("_b") == F.floor(F.greatest("lo", "start") / width)
    return h.join(s, [*keys, "_b"]).where((F.col("lo") <= F.col("_e")) & (F.col("hi") >= F.col("start")) & first).drop("_b", "_e", "_last")
