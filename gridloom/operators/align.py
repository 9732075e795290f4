"""Bringing two datasets to common times, longitudes, grids and sites."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def trim_time(ref: DataFrame, com: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both, at the (year, month) pairs that both have."""
    keys = ["year", "month"]
    both = ref.select(*keys).distinct().join(com.select(*keys).distinct(), keys)
    return ref.join(both, keys, "left_semi"), com.join(both, keys, "left_semi")


def to_signed_longitude(lon: Column) -> Column:
    """From [0, 360) to [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def to_positive_longitude(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def edges(n: int, lo: float, hi: float) -> np.ndarray:
    return np.linspace(lo, hi, n + 1)


def nested_axis(spark: SparkSession, a: np.ndarray, b: np.ndarray, name: str) -> DataFrame:
    """The axis of all breaks of two axes: ``name``, lo, hi and the index of
    the cell on either (``name``_a, ``name``_b).  A centre at equal distance
    from two cells takes the larger coordinate; outside an axis its edge cell."""
    breaks = np.unique(np.round(np.concatenate([a, b]), 9))
    mid = (breaks[1:] + breaks[:-1]) / 2

    def nearest(e: np.ndarray) -> list[int]:
        centre = (e[1:] + e[:-1]) / 2
        gap = np.abs(mid[:, None] - centre[None, :])
        return [int(np.flatnonzero(np.isclose(g, g.min(), rtol=0, atol=1e-9))[-1]) for g in gap]

    rows = [(k, float(breaks[k]), float(breaks[k + 1]), i, j) for k, (i, j) in enumerate(zip(nearest(a), nearest(b), strict=True))]
    return spark.createDataFrame(rows, f"{name} int, {name}_lo double, {name}_hi double, {name}_a int, {name}_b int")


def nest(ref: DataFrame, com: DataFrame, lat: DataFrame, lon: DataFrame) -> DataFrame:
    """Cells of the nested grid with ``ref`` and ``com`` values; axis tables are
    small, so only they are multiplied out."""
    cells = lat.join(lon, F.lit(True), "inner")
    a = ref.select(F.col("lat_idx").alias("lat_a"), F.col("lon_idx").alias("lon_a"), F.col("value").alias("ref"))
    b = com.select(F.col("lat_idx").alias("lat_b"), F.col("lon_idx").alias("lon_b"), F.col("value").alias("com"))
    return cells.join(a, ["lat_a", "lon_a"], "left").join(b, ["lat_b", "lon_b"], "left")


def neighbours(sites: DataFrame, sources: DataFrame, width: float, circle: bool = True) -> DataFrame:
    """Pairs of a site and the source points within ``width`` degrees of it.

    Sources are dealt to squares of that width and sites to the nine squares
    around them: an equi-join, not a product.
    """
    side = float(width) * (1 + 1e-9)
    square = lambda c: F.floor(F.col(c) / side)
    near = F.explode(F.array(*(F.struct((square("lat") + i).alias("y"), (square("lon") + j).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    s = sites.withColumn("__q", near).select(*sites.columns, F.col("__q.y").alias("__y"), F.col("__q.x").alias("__x"))
    o = sources.select(*(F.col(c).alias(f"src_{c}") for c in sources.columns), square("lat").alias("__y"), square("lon").alias("__x"))
    dy, dx = F.col("src_lat") - F.col("lat"), F.col("src_lon") - F.col("lon")
    met = s.join(o, ["__y", "__x"]).withColumn("distance", F.sqrt(dy * dy + dx * dx)).drop("__y", "__x")
    return met.where(F.col("distance") <= width) if circle else met.where((F.abs(dy) <= width) & (F.abs(dx) <= width))


def match_label(pairs: DataFrame, label: str) -> DataFrame:
    """The pairs whose source has the site's ``label``."""
    return pairs.where(F.col(f"src_{label}") == F.col(label))


def closest(pairs: DataFrame, sites: DataFrame, site: str, value: str) -> DataFrame:
    """Each site's nearest source value that isn't missing; ties to the smaller
    source id.  Sites without any stay, with a missing value."""
    best = F.min(F.when(F.col(f"src_{value}").isNotNull(), F.struct("distance", "src_id", F.col(f"src_{value}").alias(value))))
    found = pairs.groupBy(site).agg(best.alias("b")).select(site, f"b.{value}", "b.distance")
    return sites.select(site).distinct().join(found, site, "left")


def neighbourhood_mean(pairs: DataFrame, sites: DataFrame, site: str, value: str, weighted: bool = False) -> DataFrame:
    """Plain or inverse-distance means, distances no less than 0.1, and
    ``std``, the deviation within the neighbourhood.  Sites without neighbours
    stay, with missing values."""
    v = F.col(f"src_{value}")
    w = 1 / F.greatest(F.col("distance"), F.lit(0.1)) if weighted else F.lit(1.0)
    mean = lambda x: F.try_divide(F.sum(x * w), F.sum(F.when(v.isNotNull(), w)))
    within = Window.partitionBy(site)
    middle = F.try_divide(F.sum(v * w).over(within), F.sum(F.when(v.isNotNull(), w)).over(within))
    found = pairs.withColumn("__m", middle).groupBy(site).agg(mean(v).alias(value), F.sqrt(mean(F.pow(v - F.col("__m"), 2))).alias("std"))
    return sites.select(site).distinct().join(found, site, "left")


#: How site values are taken from a neighbourhood, by name.
SITE_EXTRACT = {
    "closest": lambda pairs, sites, site, value: closest(pairs, sites, site, value).select(site, value),
    "mean": lambda pairs, sites, site, value: neighbourhood_mean(pairs, sites, site, value).select(site, value),
    "weighted_mean": lambda pairs, sites, site, value: neighbourhood_mean(pairs, sites, site, value, weighted=True).select(site, value),
}


def extract_sites(sites: DataFrame, sources: DataFrame, how: str, width: float, value: str = "value", site: str = "site_id", circle: bool = True, label: str | None = None) -> DataFrame:
    """``value`` of the sources (``id``, ``lat``, ``lon``) at the sites by one of
    SITE_EXTRACT, over sources within ``width`` degrees and, with ``label``, of
    the site's label."""
    pairs = neighbours(sites, sources, width, circle)
    return SITE_EXTRACT[how](match_label(pairs, label) if label else pairs, sites, site, value)


def nearest_axis(spark: SparkSession, target: np.ndarray, source: np.ndarray, name: str, extend: bool = True) -> DataFrame:
    """The source point nearest to each target point, as ``name``_to and
    ``name``_from; ties to the larger coordinate, and beyond the source's ends
    its end or, without ``extend``, nothing."""
    rows = []
    for k, at in enumerate(target):
        if extend or source.min() <= at <= source.max():
            gap = np.abs(source - at)
            rows.append((k, int(max(np.flatnonzero(np.isclose(gap, gap.min(), rtol=0, atol=1e-9)), key=lambda i: source[i]))))
    return spark.createDataFrame(rows, f"{name}_to int, {name}_from int")


def regrid_nearest(df: DataFrame, lat: DataFrame, lon: DataFrame) -> DataFrame:
    """Values, or the labels of a raster, at the nearest source cell."""
    moved = df.join(F.broadcast(lat), F.col("lat_idx") == F.col("lat_from")).join(F.broadcast(lon), F.col("lon_idx") == F.col("lon_from"))
    kept = [c for c in df.columns if c not in ("lat_idx", "lon_idx")]
    return moved.select(F.col("lat_to").alias("lat_idx"), F.col("lon_to").alias("lon_idx"), *kept)


def common_timescale(com: DataFrame, ref_days: float | None, com_days: float | None, keys: list[str]) -> DataFrame:
    """The comparison at the reference's steps: as it is within three days, or
    as monthly or annual means of finer steps."""
    if ref_days is None or (com_days is not None and abs(ref_days - com_days) <= 3):
        return com  # a single step has no cadence to be brought to
    if com_days is None:
        raise ValueError("a single step can't be brought to several")
    if abs(ref_days - 30) <= 3 and com_days < 28:
        return com.groupBy(*keys, "year", "month").agg(F.avg("value").alias("value"))
    if abs(ref_days - 365) <= 6 and com_days < 350:
        return com.groupBy(*keys, "year").agg(F.avg("value").alias("value"))
    raise ValueError(f"steps of {com_days} days can't be brought to {ref_days} days")
