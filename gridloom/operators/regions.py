"""Regions: boxes, rasters and maps of their scalars."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Label, name, south, north, west, east.
BOXES = [
    ("bona", "Boreal North America", 50.0, 80.0, -170.0, -60.0),
    ("tena", "Temperate North America", 30.0, 50.0, -125.0, -66.0),
    ("ceam", "Central America", 10.0, 30.0, -115.0, -80.0),
    ("nhsa", "Northern Hemisphere South America", 0.0, 13.0, -80.0, -50.0),
    ("shsa", "Southern Hemisphere South America", -60.0, 0.0, -80.0, -33.0),
    ("euro", "Europe", 35.0, 70.0, -10.0, 30.0),
    ("mide", "Middle East", 20.0, 40.0, -10.0, 60.0),
    ("nhaf", "Northern Hemisphere Africa", 0.0, 20.0, -20.0, 45.0),
    ("shaf", "Southern Hemisphere Africa", -35.0, 0.0, 10.0, 45.0),
    ("boas", "Boreal Asia", 55.0, 70.0, 30.0, 180.0),
    ("ceas", "Central Asia", 30.0, 55.0, 30.0, 143.0),
    ("seas", "Southeast Asia", 5.0, 30.0, 65.0, 120.0),
    ("eqas", "Equatorial Asia", -10.0, 10.0, 100.0, 150.0),
    ("aust", "Australia", -41.0, -11.0, 112.0, 154.0),
]


def boxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOXES, "region string, name string, south double, north double, west double, east double")


def box_ends(cells: DataFrame, regions: DataFrame, axis: str, low: str, high: str) -> DataFrame:
    """(region, ``axis``_lo, ``axis``_hi): the points of a grid's axis nearest
    to both edges of each box; ties to the larger coordinate.  An axis meets the
    table of regions, both small."""
    near = lambda edge, name: F.min(F.struct(F.abs(F.col(axis) - F.col(edge)).alias("gap"), (-F.col(axis)).alias("minus"))).alias(name)
    ends = regions.join(cells.select(axis).distinct(), F.lit(True)).groupBy("region").agg(near(low, "a"), near(high, "b"))
    return ends.select("region", (-F.col("a.minus")).alias(f"{axis}_lo"), (-F.col("b.minus")).alias(f"{axis}_hi"))


def in_box(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Cells or sites (``lat``, ``lon``) with every region whose box holds them.

    Sites lie in a box by their coordinates; the cells of a grid reach from the
    points nearest to a box's edges, which may lie outside.  Boxes are spelt out
    along the axes first, so that cells meet them by equal coordinates."""
    if "site_id" in cells.columns:
        along = regions.join(cells.select("lat").distinct(), F.col("lat").between(F.col("south"), F.col("north")))
        return cells.join(along, "lat").where(F.col("lon").between(F.col("west"), F.col("east")))
    ends = box_ends(cells, regions, "lat", "south", "north").join(box_ends(cells, regions, "lon", "west", "east"), "region")
    along = regions.join(ends, "region").join(cells.select("lat").distinct(), F.col("lat").between(F.col("lat_lo"), F.col("lat_hi")))
    return cells.join(along, "lat").where(F.col("lon").between(F.col("lon_lo"), F.col("lon_hi"))).drop("lat_lo", "lat_hi", "lon_lo", "lon_hi")


def scalars_to_map(cells: DataFrame, regions: DataFrame, scalars: DataFrame) -> DataFrame:
    """Cells with the sum of the scalars of all regions over them, or NULL."""
    covered = in_box(cells, regions).join(scalars, "region").groupBy("lat_idx", "lon_idx").agg(F.sum("scalar").alias("value"))
    return cells.select("lat_idx", "lon_idx").join(covered, ["lat_idx", "lon_idx"], "left")


class Regions:
    """Labels with their names, sources and either boxes or rasters.

    Boxes are a table of their own; a raster is a DataFrame (label, lat_idx,
    lon_idx) of the cells of its regions.
    """

    def __init__(self) -> None:
        self._boxes = {r[0]: r for r in BOXES}
        self._rasters: dict[str, tuple[str, str, DataFrame]] = {}
        self._sources = dict.fromkeys(self._boxes, "built in")

    def add_box(self, label: str, name: str, south: float, north: float, west: float, east: float, source: str = "user") -> None:
        self._checked(label)
        self._boxes[label], self._sources[label] = (label, name, float(south), float(north), float(west), float(east)), source

    def add_raster(self, cells: DataFrame, names: dict[str, str], source: str = "user") -> list[str]:
        for label, name in names.items():
            self._checked(label)
            self._rasters[label], self._sources[label] = (label, name, cells), source
        return list(names)

    @staticmethod
    def _checked(label: str) -> None:
        if not re.fullmatch("[a-z0-9]+", label):
            raise ValueError(f"labels have small letters and digits only, not {label!r}")

    def name(self, label: str) -> str:
        return self._held(label)[1]

    def source(self, label: str) -> str:
        self._held(label)
        return self._sources[label]

    def _held(self, label: str):
        found = self._boxes.get(label) or self._rasters.get(label)
        if found is None:
            raise ValueError(f"unknown region {label!r}")
        return found

    def mask(self, cells: DataFrame, label: str | None, trim: bool = True, value: str = "value") -> DataFrame:
        """The cells of a region; without ``trim`` others stay with missing values."""
        if label is None:
            return cells
        found = self._held(label)
        if label in self._boxes:
            _, _, south, north, west, east = found
            if "site_id" in cells.columns:
                held = F.col("lat").between(south, north) & F.col("lon").between(west, east)
                return cells.where(held) if trim else cells.withColumn(value, F.when(held, F.col(value)))
            if trim:
                return nearest_box(nearest_box(cells, "lat", south, north), "lon", west, east)
            rows = cells.withColumns({"__lat": F.col("lat").between(*nearest_ends(cells, "lat", south, north)), "__lon": F.col("lon").between(*nearest_ends(cells, "lon", west, east))})
            return rows.withColumn(value, F.when(F.col("__lat") & F.col("__lon"), F.col(value))).select(*cells.columns)
        inside = found[2].where(F.col("label") == label).select("lat_idx", "lon_idx").distinct()
        if trim:
            return cells.join(inside, ["lat_idx", "lon_idx"], "left_semi")
        marked = cells.join(inside.withColumn("__in", F.lit(True)), ["lat_idx", "lon_idx"], "left")
        return marked.withColumn(value, F.when(F.col("__in"), F.col(value))).select(*cells.columns)


def nearest_ends(cells: DataFrame, axis: str, lo: float, hi: float) -> tuple[Column, Column]:
    """The axis points nearest to both, as scalars; ties to the larger coordinate."""
    ends = cells.agg(*(F.min(F.struct(F.abs(F.col(axis) - at).alias("gap"), (-F.col(axis)).alias("minus"))).alias(n) for at, n in ((lo, "a"), (hi, "b"))))
    ends = ends.select((-F.col("a.minus")).alias("a"), (-F.col("b.minus")).alias("b"))
    return ends.select("a").scalar(), ends.select("b").scalar()


def nearest_box(cells: DataFrame, axis: str, lo: float, hi: float) -> DataFrame:
    """Cells from the axis point nearest to ``lo`` to that nearest to ``hi``,
    which may lie outside; ties to the larger coordinate."""
    return cells.where(F.col(axis).between(*nearest_ends(cells, axis, lo, hi)))


def quantile_map(cells: DataFrame, regions: DataFrame, database: DataFrame, variable: str, quantile: int, kind: str = "bias") -> DataFrame:
    """Cells with the sum of a variable's quantile over the regions on them."""
    chosen = database.where((F.col("quantile") == quantile) & (F.col("type") == kind) & (F.col("variable") == variable))
    return scalars_to_map(cells, regions, chosen.select("region", F.col("value").alias("scalar")))
