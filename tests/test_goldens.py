"""Published values of seeded random cubes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.measures import EARTH_RADIUS, cell_area
from gridloom.operators import align, reduce


@pytest.fixture(scope="module")
def small_grid(spark):
    values = np.random.RandomState(1).rand(5, 4, 4) * 1e-8
    lat, lon = [-67.5, -22.5, 22.5, 67.5], [-135.0, -45.0, 45.0, 135.0]
    rows = [(t, i, j, lat[i], lon[j], float(values[t, i, j])) for t in range(5) for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "t int, lat_idx int, lon_idx int, lat double, lon double, value double").cache()


def area():
    return cell_area(F.col("lat") - 22.5, F.col("lat") + 22.5, F.col("lon") - 45, F.col("lon") + 45)


def test_total_in_petagrams(small_grid):
    per_time = reduce.integrate(small_grid, ["t"], area(), mean=False)
    total = reduce.integrate(per_time, [], F.lit(30 * 86400.0), mean=False).first()["value"]
    assert total * 1e-12 == pytest.approx(31.53474998108379, rel=1e-6)


def test_mean_in_grams_a_day(small_grid):
    per_time = reduce.integrate(small_grid, ["t"], area())
    assert reduce.integrate(per_time, [], F.lit(30.0)).first()["value"] * 86400e3 == pytest.approx(0.4121668497188348, rel=1e-6)


def test_deviation_in_time(small_grid):
    out = reduce.weighted_std(small_grid, ["lat_idx", "lon_idx"], F.lit(30.0)).agg(F.sum("value")).first()[0]
    assert out == pytest.approx(4.343761009115869e-08, rel=1e-6)


def test_sphere(spark):
    whole = spark.range(1).select(cell_area(F.lit(-90.0), F.lit(90.0), F.lit(-180.0), F.lit(180.0))).first()[0]
    assert whole == pytest.approx(4 * np.pi * EARTH_RADIUS**2, rel=1e-12)


def test_coarsening_keeps_the_mean(small_grid):
    fine = reduce.integrate(small_grid.where("t = 0"), [], area()).first()["value"]
    coarse = small_grid.where("t = 0").groupBy(F.floor(F.col("lat_idx") / 2).alias("y")).agg(F.sum(area()).alias("a"), (F.sum(F.col("value") * area()) / F.sum(area())).alias("v"))
    assert coarse.agg(F.sum(F.col("v") * F.col("a")) / F.sum("a")).first()[0] == pytest.approx(fine, rel=1e-12)


def test_nested_axis_ties_take_the_larger_coordinate(spark):
    rows = align.nested_axis(spark, np.array([0.0, 10, 20]), np.array([0.0, 20]), "y").orderBy("y").collect()
    assert [(r["y_lo"], r["y_hi"], r["y_a"], r["y_b"]) for r in rows] == [(0, 10, 0, 0), (10, 20, 1, 0)]


def test_missing_values(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (2, None)], "k int, value double")
    mean = {r["k"]: r["value"] for r in reduce.integrate(df, ["k"], F.lit(3.0)).collect()}
    total = {r["k"]: r["value"] for r in reduce.integrate(df, ["k"], F.lit(3.0), mean=False).collect()}
    assert mean == {1: 2.0, 2: None} and total == {1: 6.0, 2: 0.0}
