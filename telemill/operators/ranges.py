"""Joins of events to the periods that they fall into, where one device may have very many of either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A period lies in at most so many buckets and one more; longer ones take wider buckets, each level so many times as wide.
FAN, LEVELS = 4, 12


def _number(df: DataFrame, column: str) -> Column:
    """A date in days, a timestamp in seconds, a number as it is."""
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double") / 1e6
    return c.cast("double")


def join_periods(events: DataFrame, at: str, event_keys: list[str], periods: DataFrame, low: str, high: str, period_keys: list[str], width: float) -> DataFrame:
    """All columns of both for each event and period of equal keys with low <= at <= high (inclusive; nulls never match).

    Time is cut into buckets, of the width and of FAN, FAN^2, ... times that. A period stands in
    each bucket that it touches on the level on which these are few; an event stands in its bucket
    on each level that periods are on. They meet by equality on keys, level and bucket, each pair
    once. So a device with very many events is as many groups as it has buckets, and a long period
    makes no more rows than a short one. Column names of the two sides must differ.
    """
    lo, hi = _number(periods, low), _number(periods, high)
    level = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        level = F.when(F.floor(hi / (width * FAN**k)) - F.floor(lo / (width * FAN**k)) <= FAN, k).otherwise(level)
    wide = lambda k: F.lit(float(width)) * F.pow(F.lit(float(FAN)), k.cast("double"))
    p = periods.where(lo.isNotNull() & hi.isNotNull() & (lo <= hi)).withColumn("__level", level.cast("int"))
    p = p.withColumn("__bucket", F.explode(F.sequence(F.floor(lo / wide(F.col("__level"))), F.floor(hi / wide(F.col("__level"))))))
    levels = p.agg(F.collect_set("__level").alias("__levels"))  # LEVELS values at most
    e = events.where(_number(events, at).isNotNull()).crossJoin(F.broadcast(levels)).withColumn("__on", F.explode("__levels")).drop("__levels")  # one row
    e = e.withColumn("__in", F.floor(_number(events, at) / wide(F.col("__on"))))
    same = (F.col("__on") == F.col("__level")) & (F.col("__in") == F.col("__bucket"))
    for a, b in zip(event_keys, period_keys, strict=True):
        same &= F.col(f"`{a}`") == F.col(f"`{b}`")
    return e.join(p, same & F.col(f"`{at}`").between(F.col(f"`{low}`"), F.col(f"`{high}`"))).drop("__on", "__in", "__level", "__bucket")
