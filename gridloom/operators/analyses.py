"""Scores of a comparison against a reference, from 0 to 1 (best)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.measures import month_days, season, weighted_mean
from gridloom.operators.reduce import integrate, moments

CELL = ["lat_idx", "lon_idx"]


def exponential(error: Column) -> Column:
    return F.exp(-error)


def taylor(ratio: Column, corr: Column) -> Column:
    return F.try_divide(4 * (1 + corr), F.pow(ratio + F.try_divide(F.lit(1.0), ratio), 2) * 2)


def bias_maps(ref: DataFrame, com: DataFrame, weight: Column, cell: list[str] = CELL) -> DataFrame:
    """Per cell: ref and com time means, bias, and the score of the bias over
    the reference's deviation in time; over its mean if it has a single step."""
    single = ref.agg((F.countDistinct("year", "month") <= 1).alias("s")).scalar()
    mean_r = moments(ref, cell, weight, "ref", "norm").withColumn("norm", F.when(single, F.col("ref")).otherwise(F.col("norm")))
    mean_c = integrate(com, cell, weight).withColumnRenamed("value", "com")
    both = mean_r.join(mean_c, cell, "full_outer")
    bias = F.col("com") - F.col("ref")
    return both.withColumn("bias", bias).withColumn("score", exponential(F.try_divide(F.abs(bias), F.abs(F.col("norm")))))


def quantile_bias_score(error: Column, uncertainty: Column, norm: Column) -> Column:
    off = F.greatest(F.abs(error) - uncertainty, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(off, F.abs(norm))))


def rmse_maps(ref: DataFrame, com: DataFrame, weight: Column, cell: list[str] = CELL) -> DataFrame:
    """Per cell: rmse, the centred rmse, and its score over the reference's
    centred size."""
    both = ref.select(*cell, "year", "month", F.col("value").alias("r")).join(com.select(*cell, "year", "month", F.col("value").alias("c")), [*cell, "year", "month"])
    w = Window.partitionBy(*cell)
    mean = lambda v: F.sum(F.col(v) * weight).over(w) / F.sum(weight).over(w)
    both = both.withColumn("dr", F.col("r") - mean("r")).withColumn("dc", F.col("c") - mean("c"))
    size = lambda x: F.sqrt(weighted_mean(F.pow(x, 2), weight))
    out = both.groupBy(*cell).agg(size(F.col("c") - F.col("r")).alias("rmse"), size(F.col("dc") - F.col("dr")).alias("crmse"), size(F.col("dr")).alias("crms"))
    return out.withColumn("score", exponential(F.try_divide(F.col("crmse"), F.col("crms"))))


def cycle_maps(df: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Per cell: mean and deviation of the yearly amplitude, and the position
    (0-11) of the largest month of the mean year, the first of equal ones.
    Missing months count as 0 beside others; a cell without values has none."""
    yearly = df.groupBy(*cell, "year").agg((F.max("value") - F.min("value")).alias("a"))
    amp = yearly.groupBy(*cell).agg(F.avg("a").alias("amp"), F.stddev_pop("a").alias("amp_std"))
    monthly = df.groupBy(*cell, "month").agg(F.avg("value").alias("v"))
    first = -F.max(F.struct(F.coalesce("v", F.lit(0.0)), (-(F.col("month") - 1)).alias("p")))["p"]
    top = monthly.groupBy(*cell).agg(F.when(F.count("v") > 0, first).alias("tmax"))
    return amp.join(top, cell)


def shift_score(ref: Column, com: Column) -> tuple[Column, Column]:
    """The shift of the largest month, wrapped to -6..6, and its score."""
    d = com - ref
    shift = F.when(d > 6, d - 12).when(d < -6, d + 12).otherwise(d)
    return shift, 1 - F.abs(shift) / 6.0


def spatial_distribution(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Unweighted deviations of both maps, correlation where both are present,
    and the Taylor score, by region; a reference without spread is left out."""
    out = pairs.groupBy(*keys).agg(F.stddev_pop("ref").alias("sr"), F.stddev_pop("com").alias("sc"), F.corr("ref", "com").alias("corr"))
    return out.where(F.col("sr") > 1e-12).withColumn("std", F.col("sc") / F.col("sr")).withColumn("score", taylor(F.col("std"), F.col("corr"))).select(*keys, "std", "corr", "score")


def bin_of(value: Column, lo: Column, hi: Column, n: int) -> Column:
    return F.floor((value - lo) / ((hi - lo) / n)).cast("int")


def relationship(points: DataFrame, keys: list[str], n: int = 25) -> DataFrame:
    """The response of ``dep`` in ``n`` bins of ``ind`` over the joint range:
    count, mean and deviation, bins with under 0.3 % of the points left out."""
    span = points.agg(F.min("ind").alias("lo"), F.max("ind").alias("hi"))
    binned = points.join(F.broadcast(span), F.lit(True)).withColumn("bin", F.least(F.lit(n - 1), F.greatest(F.lit(0), bin_of(F.col("ind"), F.col("lo"), F.col("hi"), n))))
    out = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("points"), F.avg("dep").alias("mean"), F.stddev_pop("dep").alias("std"))
    whole = F.sum("points").over(Window.partitionBy(*keys))
    return out.withColumn("share", F.col("points") / whole).where("share >= 0.003").select(*keys, "bin", "points", "mean", "std")


def histogram2d(points: DataFrame, n: int = 25) -> DataFrame:
    """Shares of the points in ``n`` by ``n`` bins over their range."""
    span = points.agg(*(f(c).alias(f"{c}_{k}") for c in ("ind", "dep") for k, f in (("lo", F.min), ("hi", F.max))))
    at = lambda c: F.least(F.lit(n - 1), bin_of(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi"), n)).alias(f"{c}_bin")
    counted = points.join(F.broadcast(span), F.lit(True)).groupBy(at("ind"), at("dep")).count()
    return counted.select("ind_bin", "dep_bin", (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("share"))


def hellinger(ref: DataFrame, com: DataFrame, cell: list[str], n: int = 25) -> DataFrame:
    """Per cell, one less the Hellinger distance of the values in ``n`` bins
    over the range of both datasets, ends included."""
    span = ref.select("value").unionByName(com.select("value")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()

    def shares(df: DataFrame, name: str) -> DataFrame:
        b = df.where(F.col("value").isNotNull()).withColumn("bin", F.least(F.lit(n - 1), bin_of(F.col("value"), lo, hi, n)))
        c = b.groupBy(*cell, "bin").count()
        return c.select(*cell, "bin", (F.col("count") / F.sum("count").over(Window.partitionBy(*cell))).alias(name))

    both = shares(ref, "p").join(shares(com, "q"), [*cell, "bin"], "full_outer")
    gap = F.sqrt(F.coalesce("p", F.lit(0.0))) - F.sqrt(F.coalesce("q", F.lit(0.0)))
    return both.groupBy(*cell).agg((1 - F.sqrt(F.sum(F.pow(gap, 2))) / F.sqrt(F.lit(2.0))).alias("score"))


def area_overlap(ref: DataFrame, com: DataFrame, area: Column, cell: list[str] = CELL) -> DataFrame:
    """Areas where both hold, only the reference, only the comparison; scores."""
    both = ref.select(*cell, F.col("held").alias("r")).join(com.select(*cell, F.col("held").alias("c")), cell, "full_outer")
    r, c = F.coalesce("r", F.lit(False)), F.coalesce("c", F.lit(False))
    total = lambda x: F.sum(F.when(x, area).otherwise(0.0))
    out = both.agg(total(r & c).alias("overlap"), total(r & ~c).alias("missed"), total(~r & c).alias("excess"))
    return out.withColumn("missed_score", F.try_divide("overlap", F.col("overlap") + F.col("missed"))).withColumn("excess_score", F.try_divide("overlap", F.col("overlap") + F.col("excess")))


def hydro_metrics(df: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Means and deviations over years and over each season's months, unweighted."""
    yearly = df.groupBy(*cell, "year").agg(F.avg("value").alias("v"))
    annual = yearly.groupBy(*cell).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).withColumn("period", F.lit("annual"))
    seasonal = df.groupBy(*cell, season(F.col("month")).alias("period")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return annual.unionByName(seasonal)


def hydro_scores(ref: DataFrame, com: DataFrame, cell: list[str] = CELL) -> DataFrame:
    r, c = hydro_metrics(ref, cell), hydro_metrics(com, cell)
    both = r.join(c.select(*cell, "period", F.col("mean").alias("com_mean")), [*cell, "period"])
    return both.select(*cell, "period", exponential(F.try_divide(F.abs(F.col("com_mean") - F.col("mean")), F.col("std"))).alias("score"))


def balance_scores(ref: DataFrame, com: DataFrame, year: int) -> DataFrame:
    """From annual (year, value, lo, hi) and (year, value): the difference at
    ``year`` over the accumulated uncertainty, and the trajectory's score."""
    w = Window.partitionBy().orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    acc = lambda c: F.sum(c).over(w)
    r = ref.select("year", F.col("value").alias("flux"), acc("value").alias("r"), acc("lo").alias("lo"), acc("hi").alias("hi"))
    c = com.select("year", F.col("value").alias("c_flux"), acc("value").alias("c"))
    both = r.join(c, "year").withColumn("u", (F.col("hi") - F.col("lo")) / 2)
    eps = F.greatest(F.col("c") - F.col("lo"), F.lit(0.0)) + F.greatest(F.col("hi") - F.col("c"), F.lit(0.0))
    gap = F.exp(-F.log(F.lit(2.0)) * F.abs(F.col("c_flux") - F.col("flux")) / F.when(F.col("u") < 1e-8, F.abs(F.col("flux"))).otherwise(F.col("u")))
    return both.agg(F.max(F.when(F.col("year") == year, gap)).alias("difference_score"), F.avg(F.exp(-F.try_divide(eps, F.col("u")))).alias("trajectory_score"))


def timeseries_scores(ref: DataFrame, com: DataFrame, weight: Column) -> DataFrame:
    """Means, bias score, ratio of weighted deviations, correlation, Taylor."""
    both = ref.select("year", "month", F.col("value").alias("r")).join(com.select("year", "month", F.col("value").alias("c")), ["year", "month"])
    w = Window.partitionBy()
    for v in ("r", "c"):
        both = both.withColumn(f"d{v}", F.col(v) - F.sum(F.col(v) * weight).over(w) / F.sum(weight).over(w))
    out = both.agg(
        weighted_mean(F.col("r"), weight).alias("ref_mean"), weighted_mean(F.col("c"), weight).alias("com_mean"),
        (F.sqrt(weighted_mean(F.pow("dc", F.lit(2)), weight)) / F.sqrt(weighted_mean(F.pow("dr", F.lit(2)), weight))).alias("std"), F.corr("r", "c").alias("corr"),
    )
    return out.withColumn("bias_score", exponential(F.abs((F.col("com_mean") - F.col("ref_mean")) / F.col("ref_mean")))).withColumn("taylor_score", taylor(F.col("std"), F.col("corr")))


def bias_with_uncertainty(ref: DataFrame, com: DataFrame, unsure: DataFrame, weight: Column, cell: list[str] = CELL) -> DataFrame:
    """Bias maps whose score leaves out what ``unsure`` (cell, uncertainty) covers."""
    maps = bias_maps(ref, com, weight, cell).join(unsure, cell, "left")
    off = F.greatest(F.abs(F.col("bias")) - F.coalesce("uncertainty", F.lit(0.0)), F.lit(0.0))
    return maps.withColumn("score", F.when(F.col("bias").isNotNull(), exponential(F.try_divide(off, F.abs(F.col("norm"))))))


def seasonal_bias(ref: DataFrame, com: DataFrame, keys: list[str]) -> DataFrame:
    """Per cell and season of the calendar: both day-weighted means, their bias."""
    mean = lambda df, n: df.groupBy(*keys, season(F.col("month")).alias("season")).agg(weighted_mean(F.col("value"), month_days(F.col("month"))).alias(n))
    return mean(ref, "ref").join(mean(com, "com"), [*keys, "season"]).withColumn("bias", F.col("com") - F.col("ref"))


def relationship_score(ref: DataFrame, com: DataFrame, n: int = 25) -> DataFrame:
    """One score of two responses in the reference's bins.

    A bin that either leaves out counts with the reference's whole mean, and
    points of the comparison outside the range go to the bins at its ends.
    """
    span = ref.agg(F.min("ind").alias("lo"), F.max("ind").alias("hi"))

    def response(df: DataFrame, mean: str, held: str) -> DataFrame:
        at = F.least(F.lit(n - 1), F.greatest(F.lit(0), bin_of(F.col("ind"), F.col("lo"), F.col("hi"), n))).alias("bin")
        out = df.join(F.broadcast(span), F.lit(True)).groupBy(at).agg(F.count(F.lit(1)).alias("k"), F.avg("dep").alias(mean))
        return out.select("bin", mean, (F.col("k") / F.sum("k").over(Window.partitionBy()) >= 0.003).alias(held))

    both = response(ref, "r", "r_held").join(response(com, "c", "c_held"), "bin", "left")
    gap = F.when(F.col("r_held") & F.coalesce("c_held", F.lit(False)), F.pow(F.col("r") - F.col("c"), 2)).otherwise(F.pow("r", F.lit(2)))
    return both.agg(exponential(F.try_divide(F.sqrt(F.sum(gap)), F.sqrt(F.sum(F.pow("r", F.lit(2)))))).alias("score"))
