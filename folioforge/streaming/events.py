"""Streaming over events: an extension, with no counterpart among the ported operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Count and sum of value of each event type in each window."""
    timed = events.withWatermark("ts", late) if late else events
    grouped = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """Sessions of each user, which end after a gap without events."""
    timed = events.withWatermark("ts", late) if late else events
    grouped = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), "n")


def ema(values: Column, keep: float = 0.7) -> Column:
    """The exponential moving average at the end of an ordered array, which starts at its first
    element."""
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) > 0, F.aggregate(rest, F.get(values, F.lit(0)), lambda a, x: a * keep + x * (1 - keep)))


def ema_by_user(events: DataFrame, keep: float = 0.7) -> DataFrame:
    """ema and n of each user. A day's events fold into what they keep of the average before and
    what they add, and these into one another, so no array holds more than a day or a user's days."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.coalesce("value", F.lit(0.0)).alias("v"))))
    days = events.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(ordered.alias("e"))
    added = F.aggregate("e", F.lit(0.0), lambda a, x: a * keep + x["v"] * (1 - keep))
    days = days.select("user_id", "day", F.size("e").alias("n"), F.get("e", F.lit(0))["v"].alias("first"), F.pow(F.lit(keep), F.size("e")).alias("kept"), added.alias("added"))
    users = days.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", "first", "kept", "added"))).alias("d"), F.sum("n").alias("n"))
    whole = F.aggregate("d", F.get("d", F.lit(0))["first"], lambda a, x: a * x["kept"] + x["added"])  # an average of one value is that value
    return users.select("user_id", F.round(whole, 6).alias("ema"), "n")
