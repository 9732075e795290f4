"""Tables of scores and maps for reports, and choices among catalogued files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALAR_KEYS = ["source", "region", "analysis", "name"]


def first_rows(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each group along ``order``."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.where("__n = 1").drop("__n")


def heading_means(scalars: DataFrame) -> DataFrame:
    """Means by region, source and name at the three levels of headings:
    section, section::variable, section::variable!!dataset."""
    second = F.concat_ws("::", "section", "variable")
    named = scalars.select("region", "source", F.regexp_replace("name", r" \[1\]$", "").alias("name"), "value", F.explode(F.array("section", second, F.concat_ws("!!", second, "dataset"))).alias("heading"))
    return named.groupBy("region", "source", "heading", "name").agg(F.avg("value").alias("value"))


def plot_limits(maps: DataFrame, pad: float = 1.0, symmetric: tuple[str, ...] = ("bias",)) -> DataFrame:
    """From (name, value) over all sources: limits by quantile, 0 to 1 for
    scores, and even on both sides for biases."""
    ends = F.percentile("value", F.array(F.lit(pad / 100), F.lit(1 - pad / 100)))
    found = maps.groupBy("name").agg(ends.alias("q")).select("name", F.coalesce(F.col("q")[0], F.lit(0.0)).alias("low"), F.coalesce(F.col("q")[1], F.lit(1.0)).alias("high"))
    most = F.greatest(F.abs("low"), F.abs("high"))
    even = F.col("name").rlike("|".join(symmetric)) if symmetric else F.lit(False)
    score = F.contains("name", F.lit("score"))
    return found.select("name", F.when(score, 0.0).when(even, -most).otherwise(F.col("low")).alias("low"), F.when(score, 1.0).when(even, most).otherwise(F.col("high")).alias("high"))


def extents(cells: DataFrame, value: str = "value") -> DataFrame:
    """The box of the cells with a value; the globe if there are none."""
    with_value = lambda c: F.when(F.col(value).isNotNull(), F.col(c))
    ends = [("west", F.min, "lon", -180.0), ("east", F.max, "lon", 180.0), ("south", F.min, "lat", -90.0), ("north", F.max, "lat", 90.0)]
    return cells.agg(*(F.coalesce(f(with_value(c)), F.lit(whole)).alias(n) for n, f, c, whole in ends))


def taylor_points(scalars: DataFrame) -> DataFrame:
    """A row per source and region: normalised deviation and correlation."""
    pick = lambda n: F.max(F.when(F.startswith("name", F.lit(n)), F.col("value")))
    return scalars.groupBy("source", "region").agg(pick("Normalized Standard Deviation").alias("std"), pick("Correlation").alias("corr"))


def by_category(df: DataFrame, order: DataFrame) -> DataFrame:
    """Sorted by the rank that ``order`` (category, rank) gives, then by source."""
    return df.join(F.broadcast(order), "category", "left").orderBy(F.col("rank").asc_nulls_last(), F.lower("source")).drop("rank")


def largest_members(catalog: DataFrame) -> DataFrame:
    """Members that have as many variables as the best member of their model."""
    held = catalog.groupBy("source_id", "member_id", "grid_label").agg(F.countDistinct("variable_id").alias("n"))
    best = F.max("n").over(Window.partitionBy("source_id"))
    kept = held.withColumn("best", best).where("n = best").select("source_id", "member_id", "grid_label")
    return catalog.join(kept, ["source_id", "member_id", "grid_label"], "left_semi")


def one_table(catalog: DataFrame) -> DataFrame:
    """One file of each variable and frequency of a member; the first by table and path."""
    keys = ["source_id", "member_id", "grid_label", "variable_id", "frequency"]
    return first_rows(catalog, keys, F.struct("table_id", "path"))


def regridded_first(catalog: DataFrame) -> DataFrame:
    """The grid of each member that is not native, if there is one."""
    grids = catalog.select("source_id", "member_id", "grid_label").distinct()
    best = first_rows(grids, ["source_id", "member_id"], F.struct((F.col("grid_label") == "gn").alias("native"), "grid_label"))
    return catalog.join(best, ["source_id", "member_id", "grid_label"], "left_semi")


def at_frequency(catalog: DataFrame, days: Column, target: float) -> DataFrame:
    """Of each variable, the rows whose step is nearest to ``target`` days."""
    gap = F.abs(days - F.lit(target))
    near = F.min("__gap").over(Window.partitionBy("variable_id"))
    return catalog.withColumn("__gap", gap).withColumn("__near", near).where("__gap <=> __near").drop("__gap", "__near")
