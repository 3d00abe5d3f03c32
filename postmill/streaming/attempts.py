"""Fetch attempts as a stream: the first attempt of each run and endpoint is taken, late ones within the watermark are replays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_attempts(attempts: DataFrame, keys: list[str], at: str = "finished_at", lateness: str = "1 hour") -> DataFrame:
    """attempts without replays; state is kept for `lateness` only."""
    return attempts.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def counters(attempts: DataFrame, at: str = "finished_at", lateness: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Attempts and rows seen for each endpoint and window of event time."""
    counted = attempts.withWatermark(at, lateness).groupBy(F.window(at, window), "endpoint_id")
    return counted.agg(F.count("*").alias("attempts"), F.sum("seen").alias("seen"))
