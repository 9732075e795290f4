"""Weights in time, space and depth, and weighted reductions as expressions.

Missing values are NULL.  A weighted mean leaves them out of both sums; a
weighted sum over missing values only is 0, as a mean over them is missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres.
EARTH_RADIUS = 6.371e6
#: kg m-3.
WATER_DENSITY = 998.2071
MONTH_DAYS = {
    "noleap": (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31),
    "all_leap": (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31),
    "360_day": (30,) * 12,
}


def present(value: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def month_days(month: Column, calendar: str = "noleap") -> Column:
    return F.element_at(F.array(*(F.lit(float(d)) for d in MONTH_DAYS[calendar])), month)


def band_height(lo: Column, hi: Column) -> Column:
    return F.sin(F.radians(hi)) - F.sin(F.radians(lo))


def cell_area(lat_lo: Column, lat_hi: Column, lon_lo: Column, lon_hi: Column) -> Column:
    """Square metres of a longitude-latitude box on the sphere."""
    return F.lit(EARTH_RADIUS**2) * F.radians(lon_hi - lon_lo) * band_height(lat_lo, lat_hi)


def weighted_sum(value: Column, weight: Column) -> Column:
    return F.coalesce(F.sum(value * weight), F.lit(0.0))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def adjacent_steps(position: Column, order) -> Column:
    """Widths from centres alone: the mean of the two neighbouring steps, the
    one there is at the ends; NULL for a single step."""
    back, ahead = position - F.lag(position).over(order), F.lead(position).over(order) - position
    return (F.coalesce(back, ahead) + F.coalesce(ahead, back)) / 2


def season(month: Column) -> Column:
    names = ["DJF", "DJF", "MAM", "MAM", "MAM", "JJA", "JJA", "JJA", "SON", "SON", "SON", "DJF"]
    return F.element_at(F.array(*map(F.lit, names)), month)


def water_year(year: Column, month: Column) -> Column:
    return F.when(month > 9, year).otherwise(year - 1)


def scalar_uncertainty(value: Column, lo: Column, hi: Column) -> Column:
    """The root of the squared distances to both bounds."""
    return F.sqrt(F.pow(value - lo, 2) + F.pow(value - hi, 2))
