"""Sensitivity of runoff to temperature and precipitation, by basin."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.measures import water_year, weighted_mean
from gridloom.functions.student import two_sided
from gridloom.operators.transforms import anomaly_percent, centred_mean

SCHEMA = "basin string, tas double, tas_low double, tas_high double, pr double, pr_low double, pr_high double, r2 double, cond double"
_FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]
FORCINGS = ("mrro", "tas", "pr")


def basin_years(df: DataFrame, days: Column, area: Column) -> DataFrame:
    """From (basin, lat_idx, lon_idx, year, month, mrro, tas, pr): the means of
    water years, weighted by days, and of basins, weighted by area.  A missing
    month keeps its days."""
    cell = ["basin", "lat_idx", "lon_idx"]
    years = df.groupBy(*cell, water_year(F.col("year"), F.col("month")).alias("water_year")).agg(
        *((F.coalesce(F.sum(F.col(v) * days), F.lit(0.0)) / F.sum(days)).alias(v) for v in FORCINGS)
    )
    return years.groupBy("basin", "water_year").agg(*(weighted_mean(F.col(v), area).alias(v) for v in FORCINGS))


def anomalies(years: DataFrame, width: int) -> DataFrame:
    """Of centred rolling means: runoff and precipitation in percent of their
    means, temperature as it is."""
    rolled = years.select("basin", "water_year", *(centred_mean(F.col(v), ["basin"], "water_year", width).alias(v) for v in FORCINGS))
    level = F.avg("tas").over(Window.partitionBy("basin"))
    return rolled.select("basin", "water_year", anomaly_percent(F.col("mrro"), ["basin"]).alias("mrro"), (F.col("tas") - level).alias("tas"), anomaly_percent(F.col("pr"), ["basin"]).alias("pr"))


def fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Least squares of runoff on temperature, precipitation and their product,
    with 95 % intervals; missing where the rows are too few."""
    basin, out = rows["basin"].iloc[0], dict.fromkeys(_FIELDS[1:])
    rows = rows.dropna()
    x = np.column_stack([np.ones(len(rows)), rows["tas"], rows["pr"], rows["tas"] * rows["pr"]])
    y, spare = rows["mrro"].to_numpy(), len(rows) - x.shape[1]
    if spare > 0 and np.linalg.matrix_rank(x) == x.shape[1]:
        inverse = np.linalg.pinv(x)
        beta = inverse @ y
        left = y - x @ beta
        error = np.sqrt(np.sum(left**2) / spare * np.sum(inverse**2, axis=1)) * two_sided(0.95, spare)
        for k, name in ((1, "tas"), (2, "pr")):
            out |= {name: beta[k], f"{name}_low": beta[k] - error[k], f"{name}_high": beta[k] + error[k]}
        total = np.sum((y - y.mean()) ** 2)
        out |= {"r2": 1 - np.sum(left**2) / total if total > 0 else None, "cond": np.linalg.cond(x)}
    return pd.DataFrame([{"basin": basin, **out}], columns=_FIELDS)


def sensitivity(df: DataFrame, days: Column, area: Column, width: int = 5) -> DataFrame:
    """One row per basin.  A basin reaches its task as a row per year only."""
    rows = anomalies(basin_years(df, days, area), width)
    return rows.groupBy("basin").applyInPandas(fit, SCHEMA)


def sensitivity_scores(ref: DataFrame, com: DataFrame) -> DataFrame:
    """Per basin: bias of both sensitivities, the reference's uncertainty, and
    the score of the bias beyond it."""
    both = ref.alias("r").join(com.alias("c"), "basin")
    out = [F.col("basin")]
    for v in ("tas", "pr"):
        mid, low, high = (F.col(f"r.{v}{end}") for end in ("", "_low", "_high"))
        bias = F.col(f"c.{v}") - mid
        unsure = F.sqrt(F.pow(mid - low, 2) + F.pow(high - mid, 2))
        out += [bias.alias(f"{v}_bias"), unsure.alias(f"{v}_uncertainty"), F.exp(-F.greatest(F.abs(bias) - unsure, F.lit(0.0))).alias(f"{v}_score")]
    return both.select(*out)
