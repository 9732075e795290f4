"""Resampling of streams: the batch aggregates with a bound on lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.resample import DAILY_INDICES, REDUCTIONS


def windowed_mean(stream: DataFrame, keys: list[str], when: str, width: str, late: str, value: str = "value") -> DataFrame:
    """Means of tumbling windows; rows over ``late`` behind are left out and
    each window comes out once it can't change (append mode)."""
    timed = stream.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late)
    out = timed.groupBy(*keys, F.window(when, width).alias("w")).agg(F.avg(value).alias(value), F.count(value).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), value, "n")


def daily_flags(stream: DataFrame, keys: list[str], when: str, index: str, late: str, value: str = "value") -> DataFrame:
    """Per day, whether a daily index (see ``DAILY_INDICES``) holds."""
    how, condition = DAILY_INDICES[index]
    timed = stream.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late)
    daily = timed.groupBy(*keys, F.window(when, "1 day").alias("w")).agg(REDUCTIONS[how](value).alias(value))
    return daily.select(*keys, F.to_date("w.start").alias("day"), F.coalesce(condition(F.col(value)), F.lit(False)).alias(index))
