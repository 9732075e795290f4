"""Calendar resampling, seasons and threshold indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.measures import month_days, season, water_year, weighted_mean

#: Sub-daily values become daily ones by these.
REDUCTIONS = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}


def annual_mean(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Unweighted means by calendar year."""
    return df.groupBy(*keys, "year").agg(F.avg(value).alias(value))


def monthly_mean(df: DataFrame, keys: list[str], when: str, value: str = "value") -> DataFrame:
    """Unweighted means of the months from the first to the last of the data;
    a month without any is there for each of ``keys``, with a missing value."""
    found = df.groupBy(*keys, F.year(when).alias("year"), F.month(when).alias("month")).agg(F.avg(value).alias(value))
    ends = df.agg(F.trunc(F.min(when), "month").alias("a"), F.trunc(F.max(when), "month").alias("b")).where(F.col("a").isNotNull())
    months = ends.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("at")).select(F.year("at").alias("year"), F.month("at").alias("month"))
    # a list of months is small; it meets each key once
    spine = df.select(*keys).distinct().join(F.broadcast(months), F.lit(True)) if keys else months
    return spine.join(found, [*keys, "year", "month"], "left")


def seasonal_mean(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Day-weighted means of complete seasons; December opens the next year's."""
    y = F.when(F.col("month") == 12, F.col("year") + 1).otherwise(F.col("year"))
    out = df.groupBy(*keys, season(F.col("month")).alias("season"), y.alias("season_year")).agg(
        weighted_mean(F.col(value), month_days(F.col("month"))).alias(value), F.countDistinct("month").alias("months")
    )
    return out.where(F.col("months") == 3).drop("months")


def seasonal_climatology(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """One day-weighted mean per season over all its complete occurrences."""
    y = F.when(F.col("month") == 12, F.col("year") + 1).otherwise(F.col("year"))
    named = df.withColumn("season", season(F.col("month"))).withColumn("season_year", y)
    group = [*keys, "season", "season_year"]
    whole = named.groupBy(*group).agg(F.countDistinct("month").alias("n")).where("n = 3").select(*group)
    return named.join(whole, group, "left_semi").groupBy(*keys, "season").agg(weighted_mean(F.col(value), month_days(F.col("month"))).alias(value))


def monthly_climatology(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys, "month").agg(F.avg(value).alias(value))


def water_year_mean(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Day-weighted means from October to September; missing values count in
    the days but not in the sum."""
    days = month_days(F.col("month"))
    mean = F.coalesce(F.sum(F.col(value) * days), F.lit(0.0)) / F.sum(days)
    return df.groupBy(*keys, water_year(F.col("year"), F.col("month")).alias("water_year")).agg(mean.alias(value))


def threshold_days(df: DataFrame, keys: list[str], when: str, reduction: str, condition, value: str = "value") -> DataFrame:
    """Days a month whose daily value meets ``condition``."""
    daily = df.groupBy(*keys, F.to_date(when).alias("day")).agg(REDUCTIONS[reduction](value).alias(value))
    met = F.sum(F.coalesce(condition(F.col(value)), F.lit(False)).cast("int")).cast("long")
    return daily.groupBy(*keys, F.year("day").alias("year"), F.month("day").alias("month")).agg(met.alias("days"))


#: Reduction and condition of the daily indices (mm/day, degC).
DAILY_INDICES = {
    "wet_days": ("mean", lambda v: v >= 1),
    "summer_days": ("max", lambda v: v >= 25),
    "ice_days": ("max", lambda v: v < 0),
    "tropical_nights": ("min", lambda v: v > 20),
    "frost_days": ("min", lambda v: v < 0),
}


def on_condition(df: DataFrame, keys: list[str], condition: Column, how: str) -> DataFrame:
    """How often (sum) or how much of the time (mean) a condition holds."""
    met = F.coalesce(condition, F.lit(False)).cast("double")
    return df.groupBy(*keys).agg((F.sum if how == "sum" else F.avg)(met).alias("value"))
