"""Studies: blocks of a reference, models, transforms and analyses.

Transforms take and give a cube.  Analyses take both cubes' values and give maps
by cell, whose means by region are the scalars; those that aren't maps take a
``Block`` and give scalars.  All are looked up by name, and users add theirs
with ``transform``, ``analysis`` and ``scalar_analysis``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce as folded

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import expressions
from gridloom.functions.measures import month_days, weighted_mean
from gridloom.functions.units import conversion, convert
from gridloom.operators import align, analyses, reduce, resample, runoff, transforms
from gridloom.operators.regions import Regions
from gridloom.sources import sinks
from gridloom.sources.catalog import AXES, INDEX, Catalog, MissingVariable, load_comparison, load_reference, read_study, units_of, with_units

TRANSFORMS: dict[str, Callable[..., DataFrame]] = {}
ANALYSES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}
SCALAR_ANALYSES: dict[str, Callable[[Block], DataFrame]] = {}
DEFAULT_ANALYSES = ("Bias", "RMSE", "Annual Cycle", "Spatial Distribution")
CELL = ["lat_idx", "lon_idx"]


def transform(f):
    TRANSFORMS[f.__name__] = f
    return f


def analysis(name: str):
    return lambda f: ANALYSES.setdefault(name, f)


def scalar_analysis(name: str):
    return lambda f: SCALAR_ANALYSES.setdefault(name, f)


class AnalysisNotAppropriate(ValueError):
    """The datasets are not such as an analysis is for; it is left out."""


@dataclass(frozen=True)
class Block:
    """What analyses that give scalars (region, name, type, value) work on:
    both whole cubes and, at common months and in one unit, both values."""

    ref: DataFrame
    com: DataFrame
    ref_value: DataFrame
    com_value: DataFrame
    variable: str
    units: str
    related: tuple[str, ...]
    settings: Settings


@dataclass(frozen=True)
class Settings:
    """Parameters of a study; ``dataclasses.replace`` gives changed ones."""

    regions: tuple[str | None, ...] = (None,)
    known: Regions = field(default_factory=Regions)
    group_by: tuple[str, ...] = ("source_id", "member_id", "grid_label")
    threads: int = 4


# transforms: a missing axis or variable leaves the cube as it is


def _selected(df: DataFrame, axis: str, value=None, vmin=None, vmax=None) -> DataFrame:
    if value is not None and (vmin is not None or vmax is not None):
        raise ValueError("either a value or a range")
    if axis not in df.columns:
        return df
    if value is not None:
        return transforms.select_nearest(df, axis, float(value)).drop(axis, *(["depth_idx", "dz"] if axis == "depth" else []))
    held = (F.col(axis) >= vmin if vmin is not None else F.lit(True)) & (F.col(axis) <= vmax if vmax is not None else F.lit(True))
    return df.where(held)


@transform
def select_depth(df, **at):
    return _selected(df, "depth", **at)


@transform
def select_lat(df, **at):
    return _selected(df, "lat", **at)


@transform
def select_lon(df, **at):
    return _selected(df, "lon", **at)


@transform
def select_time(df, vmin=None, vmax=None):
    """Months from ``vmin`` to ``vmax``, both included and given as 2003-01."""
    month = F.col("year") * 12 + F.col("month")
    at = lambda text: int(str(text)[:4]) * 12 + int(str(text)[5:7])
    return df.where((month >= at(vmin) if vmin else F.lit(True)) & (month <= at(vmax) if vmax else F.lit(True)))


@transform
def mask_condition(df, condition):
    """Values that meet a condition, in its unit if it has one, become missing."""
    name, held = _holds(df, condition)
    return df.withColumn(name, F.when(~F.coalesce(held, F.lit(False)), F.col(name))).withMetadata(name, df.schema[name].metadata) if name in df.columns else df


@transform
def rename(df, **names):
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns and isinstance(v, str)})


@transform
def expression(df, expr):
    name, column, _, read = expressions.formula(expr)
    return df.withColumn(name, column) if name not in df.columns and read <= set(df.columns) else df


def _integrated(df: DataFrame, varname: str, weight, gone: set[str], mean: bool) -> DataFrame:
    keys = [c for c in (*INDEX, *AXES) if c in df.columns and c not in gone]
    return reduce.integrate(df, keys, weight, mean, varname)


@transform
def integrate_time(df, varname, mean=False):
    return _integrated(df, varname, month_days(F.col("month")), {"year", "month", "time_idx", "days"}, mean) if "month" in df.columns and varname in df.columns else df


@transform
def integrate_depth(df, varname, mean=False):
    return _integrated(df, varname, F.col("dz"), {"depth", "depth_idx", "dz"}, mean) if "dz" in df.columns and varname in df.columns else df


@transform
def integrate_space(df, varname, mean=False):
    return _integrated(df, varname, F.col("area"), {"lat_idx", "lon_idx", "lat", "lon", "area"}, mean) if "area" in df.columns and varname in df.columns else df


@transform
def soil_moisture_to_vol_fraction(df, varname="mrsos"):
    return df.withColumn(varname, transforms.volume_fraction(F.col(varname), F.col("dz") if "dz" in df.columns else F.lit(0.1))) if varname in df.columns else df


def _cells(df: DataFrame, *gone: str) -> list[str]:
    """The index and axis columns of a cube less ``gone`` and the times."""
    return [c for c in (*INDEX, *AXES) if c in df.columns and c not in {"time_idx", "year", "month", "days", *gone}]


@transform
def depth_gradient(df, varname):
    """The slope along depth of the variable's mean in time, in its unit per metre."""
    if not {"depth", "dz", varname} <= set(df.columns):
        return df
    units = units_of(df, varname)
    mean = integrate_time(df, varname, mean=True) if "month" in df.columns else df
    out = transforms.depth_gradient(mean, _cells(df, "depth", "depth_idx", "dz"), varname, "depth")
    return with_units(out.withColumnRenamed("slope", varname), varname, f"{units} m-1")


@transform
def quantile(df, varname, quantiles, dims=("time",)):
    """``varname``_quantile, a row for each of ``quantiles`` over ``dims``."""
    if varname not in df.columns:
        return df
    gone = {"time": {"time_idx", "year", "month", "days"}, "lat": {"lat", "lat_idx"}, "lon": {"lon", "lon_idx"}, "depth": {"depth", "depth_idx", "dz"}, "site": {"site_id"}}
    dims, at = [dims] if isinstance(dims, str) else dims, quantiles if isinstance(quantiles, list) else [quantiles]
    lost = set().union(*(gone[d] for d in dims), {"area"} if {"lat", "lon"} & set(dims) else set())
    keys = [c for c in (*INDEX, *AXES) if c in df.columns and c not in lost]
    return reduce.quantiles(df, keys, [float(q) for q in at], varname).withColumnRenamed(varname, f"{varname}_quantile")


def _holds(df: DataFrame, cond: str):
    """A condition like ``pr >= 1 [mm/day]`` over the variable's own unit, and the variable."""
    name, op, right = expressions.condition(cond)
    if name not in df.columns:
        return name, F.lit(False)
    limit, units = expressions.quantity(right) if "[" in right else (float(right), None)
    value = convert(F.col(name), units_of(df, name), units) if units else F.col(name)
    return name, transforms.COMPARE[op](value, F.lit(limit))


@transform
def agg_time_on_condition(df, condname, cond, agg="sum", freq="yr"):
    name, held = _holds(df, cond)
    if name not in df.columns or condname in df.columns:
        return df
    keys = [*_cells(df), "year", *(["month"] if freq in ("mon", "month") else [])]
    return resample.on_condition(df, keys, held, agg).withColumnRenamed("value", condname)


@transform
def daily_threshold_index(df, condname, cond, daily_reduction="mean"):
    """Days a month on which the daily value meets ``cond``; cubes with a
    ``time`` of days or finer steps only."""
    name, _ = _holds(df, cond)
    if name not in df.columns or condname in df.columns or "time" not in df.columns:
        return df
    units = units_of(df, name)

    daily = df.groupBy(*_cells(df), F.to_date("time").alias("day")).agg(resample.REDUCTIONS[daily_reduction](name).alias(name))
    met = _holds(with_units(daily, name, units), cond)[1]
    out = daily.groupBy(*_cells(df), F.year("day").alias("year"), F.month("day").alias("month"))
    return out.agg(F.sum(F.coalesce(met, F.lit(False)).cast("int")).cast("double").alias(condname))


def _counted(name: str, cond: str, reduction: str):
    def count(df, condname=name, cond=cond, daily_reduction=reduction):
        return daily_threshold_index(df, condname, cond, daily_reduction)

    TRANSFORMS[f"count_{name}"] = count


#: Variables, conditions and daily reductions of the indices.
for _name, _cond, _how in (
    ("wet_days", "pr >= 1 [mm/day]", "mean"), ("summer_days", "tasmax >= 25 [degC]", "max"), ("ice_days", "tasmax < 0 [degC]", "max"),
    ("tropical_nights", "tasmin > 20 [degC]", "min"), ("frost_days", "tasmin < 0 [degC]", "min"),
):
    _counted(_name, _cond, _how)


@transform
def permafrost_extent(df, method="slater2013", varname="tsl", threshold=0.0, depth_max=3.5):
    """1 where the ground of some year is permafrost (``threshold`` in degC)."""
    if not {varname, "depth", "dz"} <= set(df.columns):
        return df
    cold = df.withColumn("value", convert(F.col(varname), units_of(df, varname), "degC"))
    return transforms.permafrost(cold, _cells(df, "depth", "depth_idx", "dz"), threshold, depth_max).withColumnRenamed("extent", "permafrost_extent")


@transform
def active_layer_thickness(df, method="slater2013", varname="tsl", threshold=0.0, depth_max=3.5):
    """By year, the thickness of what thaws over permafrost."""
    if not {varname, "depth", "dz"} <= set(df.columns):
        return df
    cold = df.withColumn("value", convert(F.col(varname), units_of(df, varname), "degC"))
    found = transforms.frozen_ground(cold, _cells(df, "depth", "depth_idx", "dz"), threshold, depth_max)
    return with_units(found.drop("extent").withColumnRenamed("active", "active_layer_thickness"), "active_layer_thickness", "m")


@transform
def ocean_heat_content(df, reference_year=None):
    """``ohc`` in ZJ, by year, from thetao and volcello."""
    if not {"thetao", "volcello"} <= set(df.columns):
        return df
    since = df.where(F.col("year") >= reference_year) if reference_year else df
    out = transforms.ocean_heat(since, F.col("volcello") / 1e21, "thetao")
    return with_units(out.withColumnRenamed("value", "ohc"), "ohc", "ZJ")


@transform
def msftmz_to_rapid(df, basin=0, lat=26.5):
    """``amoc`` in Sv: the largest overturning over depth near the latitude."""
    if not {"msftmz", "basin", "lat"} <= set(df.columns):
        return df
    moved = df.withColumn("value", F.col("msftmz") / 1026.0 / 1e6 if units_of(df, "msftmz") == "kg s-1" else F.col("msftmz"))
    return with_units(transforms.overturning_maximum(moved, basin, lat).withColumnRenamed("value", "amoc"), "amoc", "Sv")


@transform
def apply_label(df, label, key="label"):
    """``key`` of the cell of ``label`` (lat, lon, ``key``; a DataFrame) that is
    nearest to each cell or site."""
    if not {"lat", "lon"} <= set(df.columns):
        return df
    near = df.select("lat", "lon").distinct()
    for axis in ("lat", "lon"):
        points = label.select(F.col(axis).alias(f"{axis}_of")).distinct()
        gap = F.min(F.struct(F.abs(F.col(axis) - F.col(f"{axis}_of")).alias("gap"), (-F.col(f"{axis}_of")).alias("minus")))
        held = df.select(axis).distinct().join(points, F.lit(True)).groupBy(axis).agg((-gap["minus"]).alias(f"{axis}_of"))
        near = near.join(held, axis)
    found = near.join(label.select(F.col("lat").alias("lat_of"), F.col("lon").alias("lon_of"), key), ["lat_of", "lon_of"], "left")
    return df.join(found.select("lat", "lon", key), ["lat", "lon"], "left")


@transform
def runoff_sensitivity(df, width=5):
    """The sensitivities of runoff by basin; see ``operators.runoff``."""
    if not {"mrro", "tas", "pr", "basin", "area"} <= set(df.columns):
        return df
    return runoff.sensitivity(df, month_days(F.col("month")), F.col("area"), width)


# analyses


@analysis("Bias")
def bias(ref, com):
    return analyses.bias_maps(ref, com, month_days(F.col("month"))).select(*CELL, F.col("bias").alias("Bias"), F.col("score").alias("Bias Score"))


@analysis("RMSE")
def rmse(ref, com):
    return analyses.rmse_maps(ref, com, month_days(F.col("month"))).select(*CELL, F.col("rmse").alias("RMSE"), F.col("score").alias("RMSE Score"))


@analysis("Annual Cycle")
def cycle(ref, com):
    top = lambda df, name: analyses.cycle_maps(df).select(*CELL, F.col("tmax").alias(name))
    shift, score = analyses.shift_score(F.col("r"), F.col("c"))
    return top(ref, "r").join(top(com, "c"), CELL).select(*CELL, shift.cast("double").alias("Phase Shift"), score.alias("Seasonal Cycle Score"))


@analysis("Hydro")
def hydro(ref, com):
    return analyses.hydro_scores(ref, com).groupBy(*CELL).agg(F.avg(F.when(F.col("period") == "annual", F.col("score"))).alias("Annual Mean Score"))


def _enough_years(df: DataFrame, least: int) -> None:
    if df.select("year").distinct().limit(least).count() < least:
        raise AnalysisNotAppropriate(f"fewer than {least} years")


@analysis("Dispersion")
def dispersion(ref, com):
    _enough_years(ref, 10)
    return analyses.hellinger(ref, com, CELL).select(*CELL, F.col("score").alias("Dispersion Score"))


def _listed(row: DataFrame, names: Mapping[str, tuple[str, str]], region) -> DataFrame:
    """A row's columns as (region, name, type, value)."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(kind).alias("type"), F.col(c).cast("double").alias("value")) for c, (n, kind) in names.items()))).alias("s")
    region = region if not isinstance(region, str | None) else F.lit("None" if region is None else region)
    return row.select(region.alias("region"), each).select("region", "s.*")


@scalar_analysis("Spatial Distribution")
def spatial_distribution(block):
    weight = month_days(F.col("month"))
    mean = lambda df, name: reduce.integrate(df, CELL, weight).withColumnRenamed("value", name)
    both = mean(block.ref_value, "ref").join(mean(block.com_value, "com"), CELL, "full_outer").join(block.ref_value.select(*CELL, "lat", "lon").distinct(), CELL)
    names = {"std": ("Normalized Standard Deviation", "scalar"), "corr": ("Correlation", "scalar"), "score": ("Spatial Distribution Score", "score")}
    known = block.settings.known
    return folded(DataFrame.unionByName, (_listed(analyses.spatial_distribution(known.mask(both, x), []), names, x) for x in block.settings.regions))


@scalar_analysis("Relationship")
def relationships(block):
    """The response to each related variable, by region."""
    out = []
    for name in block.related:
        if not {name, block.variable} <= set(block.ref.columns) & set(block.com.columns):
            continue
        for region in block.settings.regions:
            points = lambda df, x=region, n=name: block.settings.known.mask(df, x).select(F.col(n).alias("ind"), F.col(block.variable).alias("dep")).dropna()
            out.append(_listed(analyses.relationship_score(points(block.ref), points(block.com)), {"score": (f"{block.variable}/{name} Score", "score")}, region))
    if not out:
        raise AnalysisNotAppropriate("no related variable")
    return folded(DataFrame.unionByName, out)


def _total(df: DataFrame) -> DataFrame:
    """A series: cubes of cells are summed over their areas."""
    if "area" not in df.columns:
        return df
    return reduce.integrate(df, ["year", "month"], F.col("area"), mean=False)


@scalar_analysis("Time Series")
def timeseries(block):
    if "lat_idx" in block.ref_value.columns:
        raise AnalysisNotAppropriate("only for series")
    names = {"ref_mean": ("Reference Mean", "scalar"), "com_mean": ("Period Mean", "scalar"), "std": ("Normalized Standard Deviation", "scalar"), "corr": ("Correlation", "scalar"), "bias_score": ("Bias Score", "score"), "taylor_score": ("Taylor Score", "score")}
    return _listed(analyses.timeseries_scores(block.ref_value, block.com_value, month_days(F.col("month"))), names, None)


@scalar_analysis("Net Biome Production")
def nbp(block):
    """Of carbon lost by the land, in Pg yr-1; scored at the last common year."""
    units = f"{block.units} m2" if "area" in block.ref_value.columns else block.units
    factor = -conversion(units, "Pg yr-1")[0]
    yearly = lambda df: resample.annual_mean(_total(df).withColumn("value", F.col("value") * factor), [])
    ref, com = yearly(block.ref_value), yearly(block.com_value)
    last = ref.join(com, "year", "left_semi").agg(F.max("year")).first()[0]
    if last is None:
        raise AnalysisNotAppropriate("no common year")
    ref = ref.withColumns({"lo": F.col("value"), "hi": F.col("value")})
    return _listed(analyses.balance_scores(ref, com, last), {"difference_score": ("Difference Score", "score"), "trajectory_score": ("Trajectory Score", "score")}, None)


@scalar_analysis("Area")
def area(block):
    """Areas in Mm2 where a variable is there at all (above 0)."""
    held = lambda df: df.groupBy(*CELL, "area").agg(F.max(F.coalesce(F.col("value") > 0, F.lit(False))).alias("held"))
    out = analyses.area_overlap(held(block.ref_value), held(block.com_value), F.col("area") / 1e12, [*CELL, "area"])
    names = {"overlap": ("Overlap Area", "scalar"), "missed": ("Missed Area", "scalar"), "excess": ("Excess Area", "scalar"), "missed_score": ("Missed Score", "score"), "excess_score": ("Excess Score", "score")}
    return _listed(out, names, None)


@scalar_analysis("Runoff Sensitivity")
def runoff_scores(block):
    """By basin: biases, uncertainties and scores of both sensitivities."""
    if "r2" not in block.ref.columns or "r2" not in block.com.columns:
        raise AnalysisNotAppropriate("needs the transform runoff_sensitivity")
    scores = runoff.sensitivity_scores(block.ref, block.com)
    names = {f"{v}_{k}": (f"{v} Sensitivity {k.title()}", "score" if k == "score" else "scalar") for v in ("tas", "pr") for k in ("bias", "uncertainty", "score")}
    return _listed(scores, names, F.col("basin"))


def _as_value(df: DataFrame, variable: str, units: str | None = None) -> DataFrame:
    """The variable as ``value``, in ``units``."""
    own = units_of(df, variable)
    value = convert(F.col(variable), own, units) if units and own != units else F.col(variable)
    return df.select(*(c for c in (*INDEX, *AXES) if c in df.columns), value.alias("value"))


def regional_scalars(maps: DataFrame, cells: DataFrame, source: str, name: str, settings: Settings) -> DataFrame:
    """Area-weighted means of maps by region, one row per map."""
    kinds = [c for c in maps.columns if c not in CELL]
    placed = maps.join(cells, CELL)
    out = []
    for label in settings.regions:
        means = settings.known.mask(placed, label).agg(*(weighted_mean(F.col(f"`{k}`"), F.col("area")).alias(k) for k in kinds))
        listed = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(f"`{k}`").alias("value")) for k in kinds))).alias("s")
        out.append(means.select(listed).select("s.*").withColumn("region", F.lit("None" if label is None else label)))
    rows = folded(DataFrame.unionByName, out)
    kind = F.when(F.endswith("name", F.lit("Score")), "score").otherwise("scalar")
    return rows.select(F.lit(source).alias("source"), "region", F.lit(name).alias("analysis"), "name", kind.alias("type"), "value")


def run_block(ref: DataFrame, models: Mapping[str, DataFrame], variable: str, chosen=DEFAULT_ANALYSES, steps: list[Mapping] = (), settings: Settings | None = None, related: tuple[str, ...] = ()) -> DataFrame:
    """Scalars of all models against one reference, on the same grid: months
    that both have, the reference's unit, and the overall score appended.
    Analyses that the datasets are not for are left out."""
    settings = settings or Settings()

    def prepared(df: DataFrame) -> DataFrame:
        for step in steps:
            for name, options in step.items():
                df = TRANSFORMS[name](df, **(options or {}))
        if variable not in df.columns:
            raise MissingVariable(f"{variable!r} is not there after the transforms")
        return df

    ref = prepared(ref)
    units, out = units_of(ref, variable), []
    ref_value = _as_value(ref, variable)
    cells = ref_value.select(*CELL, "lat", "lon", "area").distinct() if "area" in ref_value.columns and "lat_idx" in ref_value.columns else None
    for source, cube in models.items():
        cube = prepared(cube)
        a, b = ref_value, _as_value(cube, variable, units)
        if {"year", "month"} <= set(a.columns) & set(b.columns):
            a, b = align.trim_time(a, b)
        for name in chosen:
            try:
                if name in SCALAR_ANALYSES:
                    found = SCALAR_ANALYSES[name](Block(ref, cube, a, b, variable, units, tuple(related), settings))
                    out.append(found.select(F.lit(source).alias("source"), "region", F.lit(name).alias("analysis"), "name", "type", "value"))
                else:
                    out.append(regional_scalars(ANALYSES[name](a, b), cells, source, name, settings))
            except AnalysisNotAppropriate:
                continue
    if not out:
        raise MissingVariable(f"no analysis of {list(chosen)} is for these datasets")
    scalars = folded(DataFrame.unionByName, out)
    unit = F.when((F.col("type") == "score") | F.col("name").isin("Correlation", "Normalized Standard Deviation"), "1").when(F.col("name") == "Phase Shift", "months").when(F.endswith("name", F.lit("Area")), "Mm2").otherwise(units)
    scalars = scalars.withColumn("units", unit).withColumn("name", F.concat("name", F.lit(" ["), unit, F.lit("]")))
    return reduce.overall_score(scalars)


def run_study(spark: SparkSession, path: str, catalog: Catalog, models: DataFrame, out: str, settings: Settings | None = None) -> DataFrame:
    """All blocks of a study file; scalars are written by block and returned
    with their section, variable and dataset.  Blocks run side by side.

    The model database and the study, both lists of files, are read on the driver."""
    settings = settings or Settings()
    files: dict[str, dict[str, list[str]]] = {}
    for row in models.orderBy("path").collect():
        group = "-".join(row[c] for c in settings.group_by if row[c])
        files.setdefault(group, {}).setdefault(row["variable_id"], []).append(row["path"])

    def block(item) -> DataFrame | None:
        headings, setup = item
        variable, related = next(iter(setup["sources"])), setup.get("relationships")
        ref = load_reference(spark, catalog, setup["sources"], related)
        cubes = {}
        for source, paths in files.items():
            try:
                cubes[source] = load_comparison(spark, catalog, paths, variable, setup.get("alternate_vars"), [*setup["sources"], *(related or {})])
            except MissingVariable:
                continue
        if not cubes:
            return None
        scalars = run_block(ref, cubes, variable, setup.get("analyses", DEFAULT_ANALYSES), setup.get("transforms", []), settings, tuple(related or ()))
        at = f"{out.rstrip('/')}/" + "/".join(headings)
        sinks.write_scalars(scalars, at, "parquet")
        section, name, dataset = (list(headings) + [""] * 3)[:3]
        return spark.read.parquet(at).withColumns({"section": F.lit(section), "variable": F.lit(name), "dataset": F.lit(dataset)})

    with ThreadPoolExecutor(settings.threads) as pool:
        done = [d for d in pool.map(block, read_study(path)) if d is not None]
    if not done:
        raise MissingVariable("no model has a variable of this study")
    return folded(DataFrame.unionByName, done)


__all__ = ["ANALYSES", "SCALAR_ANALYSES", "TRANSFORMS", "AnalysisNotAppropriate", "Block", "Settings", "analysis", "run_block", "run_study", "scalar_analysis", "transform", "with_units"]
