"""What a dataset covers: extents, frequencies, resolutions, measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.measures import adjacent_steps

#: Days of a step.
FREQUENCIES = {"3hr": 0.125, "6hr": 0.25, "day": 1.0, "mon": 30.0, "yr": 365.0}
#: Names of dimensions in files.
SYNONYMS = {
    "time": ["time", "TIME", "month"],
    "lat": ["lat", "latitude", "Latitude", "lat_nested", "lat_", "Lat", "LATITUDE"],
    "lon": ["lon", "longitude", "Longitude", "lon_nested", "lon_", "Lon", "LONGITUDE"],
    "depth": ["depth", "lev"],
}


def dimension(columns: list[str], kind: str) -> str:
    """The column that holds dimension ``kind``; "site" is the one left over.
    None or several are an error."""
    if kind == "site":
        found = [c for c in columns if not any(c in names for names in SYNONYMS.values())]
    else:
        found = [c for c in columns if c in SYNONYMS[kind]]
    if len(found) != 1:
        raise KeyError(f"no single {kind} dimension in {columns}: {found}")
    return found[0]


def time_extent(times: DataFrame) -> DataFrame:
    """The first and the last time; bounds (lo, hi) count where there are any."""
    bounded = {"lo", "hi"} <= set(times.columns)
    return times.agg(F.min("lo" if bounded else "at").alias("first"), F.max("hi" if bounded else "at").alias("last"))


def frequency_label(step: Column) -> Column:
    """The label whose step in days is nearest, "fx" without a step."""
    nearest = F.array_min(F.array(*(F.struct(F.abs(step - d), F.lit(k).alias("rank")) for k, d in enumerate(FREQUENCIES.values()))))
    return F.when(step.isNull(), "fx").otherwise(F.element_at(F.array(*map(F.lit, FREQUENCIES)), nearest["rank"] + 1))


def mean_step(times: DataFrame, at: str) -> DataFrame:
    """``step``, the mean width in days of times given by their centres."""
    days = F.unix_micros(F.col(at).cast("timestamp")) / 86400e6
    steps = times.select(at).distinct().select(adjacent_steps(days, Window.orderBy(at)).alias("step"))
    return steps.agg(F.avg("step").alias("step"))


def spatial_resolution(cells: DataFrame) -> DataFrame:
    """The hypotenuse of the mean steps along both axes."""
    width = lambda c: cells.select(c).distinct().select((F.col(c) - F.lag(c).over(Window.orderBy(c))).alias("d")).agg(F.avg("d").alias(c))
    return width("lat").join(width("lon"), F.lit(True)).select(F.sqrt(F.col("lat") * F.col("lat") + F.col("lon") * F.col("lon")).alias("resolution"))


def measure_name(attribute: Column) -> Column:
    """The variable named in ``area: areacella``."""
    return F.nullif(F.regexp_extract(attribute, r"area:\s*(\S+)", 1), F.lit(""))


def land_area(area: Column, percent: Column) -> Column:
    """Areas by a percentage of land or sea; none left is missing."""
    part = area * percent / 100
    return F.when(part > 0, part)
