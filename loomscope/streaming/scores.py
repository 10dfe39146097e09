"""Running scores of a stream of scored responses or steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_responses(stream: DataFrame, key: str = "response_id", time: str = "logged_at", late: str = "1 hour") -> DataFrame:
    """A stream without redelivered rows: each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_scores(stream: DataFrame, keys: list[str], value: str, time: str, window: str = "10 minutes", late: str | None = "1 hour") -> DataFrame:
    """Mean and count of ``value`` for each key and window of event time; rows later than ``late`` (null: the watermark there is) are dropped."""
    marked = stream.withWatermark(time, late) if late else stream
    out = marked.groupBy(F.window(time, window).alias("w"), *keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.select(F.col("w.start").alias("start"), *keys, "mean", "n")


def sessions(stream: DataFrame, key: str, time: str, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of rows of a key that are at most ``gap`` apart."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
