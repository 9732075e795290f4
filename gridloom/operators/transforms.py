"""Dataset transforms: selections, masks, expressions and derived quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.measures import WATER_DENSITY

#: Sea water: J kg-1 K-1 and kg m-3.
SEA_HEAT, SEA_DENSITY = 3991.868, 1026.0
COMPARE = {
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
}


def select_range(df: DataFrame, axis: str, lo: float, hi: float) -> DataFrame:
    """Both ends included."""
    return df.where(F.col(axis).between(lo, hi))


def select_nearest(df: DataFrame, axis: str, at: float) -> DataFrame:
    """The rows at the axis value nearest to ``at``; ties to the larger."""
    best = df.agg(F.min(F.struct(F.abs(F.col(axis) - at), -F.col(axis).cast("double"))).alias("b"))
    return df.join(F.broadcast(best.select((-F.col("b.col2")).alias("__at"))), F.col(axis) == F.col("__at"), "left_semi")


def mask_where(df: DataFrame, op: str, limit: float, value: str = "value") -> DataFrame:
    """Values that meet the condition become missing."""
    return df.withColumn(value, F.when(~F.coalesce(COMPARE[op](F.col(value), F.lit(limit)), F.lit(False)), F.col(value)))


def expression(df: DataFrame, name: str, formula: str) -> DataFrame:
    """A new column by an arithmetic formula; division by zero is missing."""
    return df.withColumn(name, F.expr(formula))


def anomaly_percent(value: Column, keys: list[str]) -> Column:
    mean = F.avg(value).over(Window.partitionBy(*keys))
    return F.try_divide(value - mean, mean) * 100


def centred_mean(value: Column, keys: list[str], order: str, width: int) -> Column:
    """Rolling means over ``width`` (odd) rows; missing at incomplete windows."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), width // 2)
    return F.when(F.count(value).over(w) == width, F.avg(value).over(w))


def volume_fraction(mass_per_area: Column, thickness: Column) -> Column:
    """kg m-2 of water in a layer to its share of the volume."""
    return mass_per_area / thickness / F.lit(WATER_DENSITY)


def depth_gradient(df: DataFrame, keys: list[str], value: str = "value", depth: str = "depth") -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(value, depth).alias("slope"))


def frozen_ground(layers: DataFrame, keys: list[str], limit: float, deepest: float = 3.5, value: str = "value") -> DataFrame:
    """Per cell and year: whether some layer above ``deepest`` stays below
    ``limit`` in that year and the next one of the data (``extent``), and the
    thickness of the whole layers there that don't in that year (``active``,
    only within the extent).  ``layers`` has year, depth (centres) and dz; a
    layer without values isn't frozen."""
    met = layers.where(F.col("depth") - F.col("dz") / 2 < deepest)
    annual = met.groupBy(*keys, "depth", "dz", "year").agg(F.coalesce(F.max(value) < limit, F.lit(False)).alias("frozen"))
    years = layers.select("year").distinct().select("year", F.lead("year").over(Window.orderBy("year")).alias("next"))
    along = Window.partitionBy(*keys, "depth").orderBy("year")
    follows = F.coalesce((F.lead("year").over(along) == F.col("next")) & F.lead("frozen").over(along), F.lit(False))
    twice = annual.join(F.broadcast(years), "year").withColumn("both", F.col("frozen") & follows)
    whole = F.col("depth") + F.col("dz") / 2 <= deepest
    axis = met.select("depth", "dz").distinct().where(whole).agg(F.coalesce(F.sum("dz"), F.lit(0.0)).alias("t")).scalar()
    out = twice.groupBy(*keys, "year").agg(F.bool_or("both").alias("extent"), F.sum(F.when(F.col("frozen") & whole, F.col("dz")).otherwise(0.0)).alias("frozen"))
    return out.select(*keys, "year", "extent", F.when(F.col("extent"), axis - F.col("frozen")).alias("active"))


def permafrost(layers: DataFrame, keys: list[str], limit: float, deepest: float = 3.5, value: str = "value") -> DataFrame:
    """Per cell: 1 where the ground of some year is permafrost, else missing."""
    found = frozen_ground(layers, keys, limit, deepest, value).groupBy(*keys).agg(F.bool_or("extent").alias("any"))
    return found.select(*keys, F.when(F.col("any"), 1.0).alias("extent"))


def ocean_heat(df: DataFrame, volume: Column, value: str = "value") -> DataFrame:
    """Annual means of the heat content, less that of the first month."""
    monthly = df.groupBy("year", "month").agg((F.sum(F.col(value) * volume) * SEA_HEAT * SEA_DENSITY).alias("heat"))
    first = monthly.agg(F.min(F.struct("year", "month", "heat")).alias("f")).select(F.col("f.heat").alias("first"))
    return monthly.join(F.broadcast(first), F.lit(True)).groupBy("year").agg(F.avg(F.col("heat") - F.col("first")).alias("value"))


def overturning_maximum(df: DataFrame, basin: int = 0, lat: float = 26.5, value: str = "value") -> DataFrame:
    """The maximum over depth in a basin at the latitude nearest to ``lat``."""
    return select_nearest(df, "lat", lat).where(F.col("basin") == basin).groupBy("year", "month").agg(F.max(value).alias("value"))


def interval_select(axis: DataFrame, lo: float, hi: float, name: str = "lat") -> DataFrame:
    """Cells (``name``, lo, hi) that hold ``lo`` to ``hi``, the outer ones
    clipped and their centres moved; a cell that only touches is left out."""
    met = axis.where((F.col("hi") > lo) & (F.col("lo") < hi))
    low, high = F.greatest("lo", F.lit(lo)), F.least("hi", F.lit(hi))
    clipped = (low != F.col("lo")) | (high != F.col("hi"))
    return met.withColumns({name: F.when(clipped, (low + high) / 2).otherwise(F.col(name)), "lo": low, "hi": high})


def first_difference(value: Column, keys: list[str], order: list[str]) -> Column:
    """Less the first value along ``order``."""
    along = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return value - F.first(value).over(along)
