"""Where data is found: keys, paths, model databases, study files.

A cube is a Parquet table with index columns, ``lat``, ``lon``, ``area``,
``year``, ``month`` (where it has them) and a column for each variable, whose
unit is kept as the column's metadata under "units".
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce as folded

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = ("time_idx", "year", "month", "depth_idx", "site_id", "lat_idx", "lon_idx")
AXES = ("lat", "lon", "depth", "dz", "area", "days")
MODEL_SCHEMA = "source_id string, member_id string, grid_label string, variable_id string, frequency string, path string"


class MissingVariable(ValueError):
    """A dataset lacks a variable that was asked for."""


@dataclass(frozen=True)
class Catalog:
    """Keys of files below ``root``.  Paths are left to Spark's readers, so
    that wildcards and remote stores work."""

    root: str
    entries: Mapping[str, str] = field(default_factory=dict)

    def path(self, asset: str) -> str:
        known = self.entries.get(asset, asset)
        return known if known.startswith("/") or re.match(r"[a-z0-9]+://?", known) else f"{self.root.rstrip('/')}/{known}"

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted((k, self.path(k)) for k in self.entries), "key string, path string")

    def open(self, spark: SparkSession, asset: str | DataFrame) -> DataFrame:
        return asset if isinstance(asset, DataFrame) else spark.read.parquet(self.path(asset))


def units_of(df: DataFrame, variable: str) -> str:
    return df.schema[variable].metadata.get("units", "1")


def with_units(df: DataFrame, variable: str, units: str) -> DataFrame:
    return df.withMetadata(variable, {"units": units})


def merged(cubes: list[DataFrame]) -> DataFrame:
    """All variables side by side on the index columns that all cubes have;
    of columns that several have, the first value that is there."""

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        keys = [c for c in INDEX if c in a.columns and c in b.columns]
        twice = [c for c in b.columns if c in a.columns and c not in keys]
        right = b.withColumnsRenamed({c: f"__{c}" for c in twice})
        both = a.join(right, keys, "full_outer")
        filled = {c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in twice}
        out = both.withColumns(filled).drop(*(f"__{c}" for c in twice)) if twice else both
        for name in (c for d in (b, a) for c in d.columns if c in out.columns):
            if meta := (a if name in a.columns else b).schema[name].metadata:
                out = out.withMetadata(name, meta)
        return out

    return folded(joined, cubes)


def load_reference(spark: SparkSession, catalog: Catalog, sources: Mapping[str, str], relationships: Mapping[str, str] | None = None) -> DataFrame:
    """The variables of a block from the file that each is in."""
    opened = []
    for variable, asset in {**sources, **(relationships or {})}.items():
        cube = catalog.open(spark, asset)
        if variable not in cube.columns:
            raise MissingVariable(f"{variable!r} is not in {asset!r}")
        opened.append(cube.select(*(c for c in (*INDEX, *AXES, variable) if c in cube.columns)))
    return merged(opened)


def load_comparison(spark: SparkSession, catalog: Catalog, paths: Mapping[str, list[str]], variable: str, alternates: list[str] | None = None, related: list[str] | None = None) -> DataFrame:
    """A model's variables from its files by variable; the first alternate
    name that the model has stands in for a missing variable."""
    found = next((v for v in (variable, *(alternates or [])) if v in paths), None)
    if found is None:
        raise MissingVariable(f"the model has none of {[variable, *(alternates or [])]}")
    opened = []
    for name in [found, *(r for r in related or [] if r in paths and r != found)]:
        cube = spark.read.parquet(*map(catalog.path, paths[name]))
        opened.append(cube.select(*(c for c in (*INDEX, *AXES, name) if c in cube.columns)))
    return merged(opened).withColumnRenamed(found, variable)


def model_database(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files of model variables and their paths, by the names in their heads."""
    tables = [spark.read.csv(p, header=True) for p in paths]
    every = folded(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    names = [c.split()[0] for c in MODEL_SCHEMA.split(", ")]
    return every.select(*(F.col(c) if c in every.columns else F.lit(None).cast("string").alias(c) for c in names))


def quantile_database(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("variable", "region", "quantile", "type", "value", "unit")


def blocks(study: Mapping, above: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Mapping]]:
    """The headings and the setup of each block of a study: the first level
    that names its ``sources``."""
    for name, below in study.items():
        here = (*above, re.sub(r'[\\/:*?"<>|\s]', "", str(name)))
        if isinstance(below, Mapping) and "sources" in below:
            yield here, below
        elif isinstance(below, Mapping):
            yield from blocks(below, here)


def read_study(path: str) -> list[tuple[tuple[str, ...], Mapping]]:
    """Blocks of a YAML file on the driver's disk."""
    import yaml

    with open(path) as f:
        return list(blocks(yaml.safe_load(f) or {}))
