"""Weighted reductions over time, space and depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.measures import weighted_mean, weighted_sum


def integrate(df: DataFrame, keys: list[str], weight: Column, mean: bool = True, value: str = "value") -> DataFrame:
    """The weighted mean or sum of ``value`` over all dimensions but ``keys``."""
    total = (weighted_mean if mean else weighted_sum)(F.col(value), weight)
    return df.groupBy(*keys).agg(total.alias(value)) if keys else df.agg(total.alias(value))


def accumulate(df: DataFrame, keys: list[str], order: list[str], weight: Column, value: str = "value") -> DataFrame:
    """Running weighted sums along ``order``."""
    along = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.coalesce(F.sum(F.col(value) * weight).over(along), F.lit(0.0)))


def weighted_std(df: DataFrame, keys: list[str], weight: Column, value: str = "value") -> DataFrame:
    """Weighted population deviation, in two passes over one partitioning."""
    v, within = F.col(value), Window.partitionBy(*keys)
    mean = F.try_divide(F.sum(v * weight).over(within), F.sum(F.when(v.isNotNull(), weight)).over(within))
    return df.withColumn("__m", mean).groupBy(*keys).agg(F.sqrt(weighted_mean((v - F.col("__m")) ** 2, weight)).alias(value))


def moments(df: DataFrame, keys: list[str], weight: Column, mean_name: str, std_name: str, value: str = "value") -> DataFrame:
    """Weighted mean and population deviation, over one partitioning."""
    v, within = F.col(value), Window.partitionBy(*keys)
    mean = F.try_divide(F.sum(v * weight).over(within), F.sum(F.when(v.isNotNull(), weight)).over(within))
    return df.withColumn("__m", mean).groupBy(*keys).agg(F.first("__m").alias(mean_name), F.sqrt(weighted_mean((v - F.col("__m")) ** 2, weight)).alias(std_name))


def coarsen(df: DataFrame, block: int, area: Column, keys: list[str], value: str = "value") -> DataFrame:
    """Area-weighted means of ``block`` by ``block`` cells; conserves the mean."""
    to = [F.floor(F.col(c) / block).cast("int").alias(c) for c in ("lat_idx", "lon_idx")]
    return df.groupBy(*keys, *to).agg(weighted_mean(F.col(value), area).alias(value))


def quantiles(df: DataFrame, keys: list[str], at: list[float], value: str = "value") -> DataFrame:
    """Exact quantiles with linear interpolation: a row for each of ``at``."""
    found = df.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, at))).alias("q"))
    return found.select(*keys, F.posexplode("q").alias("i", value)).select(*keys, F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1).alias("quantile"), value)


def overall_score(scalars: DataFrame) -> DataFrame:
    """The mean of all scores by source and region, appended."""
    mean = scalars.where(F.col("type") == "score").groupBy("source", "region").agg(F.avg("value").alias("value"))
    return scalars.unionByName(mean.withColumns({"name": F.lit("Overall Score [1]"), "type": F.lit("score"), "units": F.lit("1")}), allowMissingColumns=True)
