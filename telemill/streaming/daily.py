"""An extension: the daily wait table kept up to date from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S


def daily_waits(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """events: ts, guid, event_name, duration -> number and sum by device, day and event; days close when the watermark passes them."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    g = e.groupBy(F.window("ts", "1 day").alias("day"), "guid", "event_name")
    return g.agg(F.count("*").alias("number_of_instances"), F.sum("duration").alias("total_duration")).select("guid", F.to_date("day.start").alias("dt"), "event_name", S.power_state("event_name").alias("acdc"), "number_of_instances", "total_duration")
