"""Runoff against published values, regions, a whole study, streams."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions.measures import cell_area
from gridloom.operators import runoff
from gridloom.operators.regions import Regions
from gridloom.plans import study
from gridloom.sources import sinks
from gridloom.sources.catalog import Catalog, MissingVariable, model_database, with_units
from gridloom.streaming.resample import daily_flags, windowed_mean


def test_runoff_sensitivity(spark):
    shape = (240, 10, 20)
    draw = lambda seed: np.random.RandomState(seed).rand(*shape) * 1e-8
    pr, tas, base = 1e3 * draw(1), 273 + 1e9 * draw(2), draw(3)
    mrro = base.mean() + 1e2 * (pr - pr.mean()) + 1e-3 * (tas - tas.mean())
    when = pd.date_range("2000-01-15", periods=240, freq="30D")
    t, i, j = (x.ravel() for x in np.indices(shape))
    frame = pd.DataFrame({"basin": "test", "lat_idx": i, "lon_idx": j, "year": when.year.values[t], "month": when.month.values[t], "mrro": mrro.ravel(), "tas": tas.ravel(), "pr": pr.ravel()})
    lo = F.col("lat_idx") * 18.0 - 90
    got = runoff.sensitivity(spark.createDataFrame(frame), F.lit(30.0), cell_area(lo, lo + 18, F.lit(0.0), F.lit(18.0)), width=9).first()
    assert got["tas"] == pytest.approx(28006.878361, rel=1e-6) and got["pr"] == pytest.approx(139.850275, rel=1e-6)
    assert got["tas_low"] < got["tas"] < got["tas_high"]


def test_runoff_of_few_years_is_missing(spark):
    rows = [("b", 0, 0, 2000 + y, 10, 1.0, 2.0, 3.0) for y in range(3)]
    df = spark.createDataFrame(rows, "basin string, lat_idx int, lon_idx int, year int, month int, mrro double, tas double, pr double")
    assert runoff.sensitivity(df, F.lit(30.0), F.lit(1.0), width=1).first()["tas"] is None


def test_regions(spark):
    cells = spark.createDataFrame([(0, 0, 45.0, 0.0, 1.0), (0, 1, -45.0, 0.0, 2.0)], "lat_idx int, lon_idx int, lat double, lon double, value double")
    known = Regions()
    known.add_raster(spark.createDataFrame([("sea", 0, 1)], "label string, lat_idx int, lon_idx int"), {"sea": "The sea"})
    values = lambda df: [r["value"] for r in df.orderBy("lat_idx", "lon_idx").collect()]
    assert values(known.mask(cells, "euro")) == [1.0] and values(known.mask(cells, "sea")) == [2.0]
    assert values(known.mask(cells, "sea", trim=False)) == [None, 2.0] and values(known.mask(cells, None)) == [1.0, 2.0]
    assert known.name("sea") == "The sea"
    for bad in (lambda: known.mask(cells, "nowhere"), lambda: known.add_box("A b", "", 0, 1, 0, 1)):
        with pytest.raises(ValueError):
            bad()


def _cube(spark, scale: float, units: str):
    rows = [(i, j, -45.0 + 90 * i, -90.0 + 180 * j, 1.0 + i, y, m, scale * (10 + 3 * math.sin(m + i) + j + 0.1 * y)) for i in range(2) for j in range(2) for y in (2000, 2001) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "lat_idx int, lon_idx int, lat double, lon double, area double, year int, month int, gpp double")
    return with_units(df, "gpp", units)


def test_whole_study(spark, tmp_path):
    _cube(spark, 1.0, "g m-2 d-1").write.parquet(f"{tmp_path}/ref/gpp")
    _cube(spark, 1e-3, "kg m-2 d-1").write.parquet(f"{tmp_path}/same")
    _cube(spark, 2.0, "g m-2 d-1").write.parquet(f"{tmp_path}/twice")
    (tmp_path / "models.csv").write_text(f"source_id,member_id,grid_label,variable_id,path\nsame,r1,gn,gpp,{tmp_path}/same\ntwice,r1,gn,gpp,{tmp_path}/twice\nother,r1,gn,tas,{tmp_path}/none\n")
    (tmp_path / "study.yaml").write_text("Carbon:\n  Gross Production:\n    Somewhere:\n      sources:\n        gpp: gpp\n      transforms:\n        - select_time:\n            vmin: 2000-01\n            vmax: 2001-12\n")
    out = study.run_study(spark, str(tmp_path / "study.yaml"), Catalog(f"{tmp_path}/ref"), model_database(spark, [f"{tmp_path}/models.csv"]), f"{tmp_path}/out", study.Settings(regions=(None, "euro")))
    rows = {(r["source"], r["region"], r["name"]): r["value"] for r in out.collect()}
    assert rows["same-r1-gn", "None", "Overall Score [1]"] == pytest.approx(1.0)
    assert rows["same-r1-gn", "None", "Bias [g m-2 d-1]"] == pytest.approx(0.0, abs=1e-9)
    assert rows["twice-r1-gn", "None", "Bias Score [1]"] < 0.1 and not any(s.startswith("other") for s, _, _ in rows)
    bundle = sinks.bundle(out, Regions().name, Regions().source)
    assert bundle["RESULTS"]["None"]["same-r1-gn"]["Carbon::GrossProduction!!Somewhere"]["Overall Score"] == pytest.approx(1.0)
    assert "Bias Score" in sinks.page("Study", out)


def test_transforms_leave_what_they_lack(spark):
    cube = _cube(spark, 1.0, "1")
    assert study.TRANSFORMS["select_depth"](cube, value=0).count() == cube.count()
    assert study.TRANSFORMS["expression"](cube, expr="x = gpp + absent").columns == cube.columns
    assert study.TRANSFORMS["select_lat"](cube, value=40).select("lat_idx").distinct().collect()[0][0] == 1
    with pytest.raises(MissingVariable):
        study.run_block(cube, {"m": cube}, "gpp", steps=[{"rename": {"gpp": "npp"}}])


def test_registered_names():
    assert {"Bias", "RMSE", "Annual Cycle", "Hydro", "Dispersion"} <= set(study.ANALYSES)
    assert {"Spatial Distribution", "Relationship", "Time Series", "Net Biome Production", "Area", "Runoff Sensitivity"} == set(study.SCALAR_ANALYSES)
    assert set(study.DEFAULT_ANALYSES) <= set(study.ANALYSES) | set(study.SCALAR_ANALYSES)
    assert len(study.TRANSFORMS) >= 26


def test_layer_transforms(spark):
    """Layers of 1 m: the first thaws in 2001, the second never, the third isn't whole above 2.5 m."""
    warm = {(0, 2001): 1.0}
    rows = [(0, 0, 45.0, 10.0, 1.0, d, d + 0.5, 1.0, y, m, 272.15 + 2 * warm.get((d, y), 0.0) + d) for d in range(3) for y in (2000, 2001, 2002) for m in (1, 7) if d < 2]
    rows += [(0, 1, 45.0, 30.0, 1.0, d, d + 0.5, 1.0, y, m, 290.0 - 2 * d) for d in range(2) for y in (2000, 2001, 2002) for m in (1, 7)]
    df = spark.createDataFrame(rows, "lat_idx int, lon_idx int, lat double, lon double, area double, depth_idx int, depth double, dz double, year int, month int, tsl double")
    df = with_units(df, "tsl", "K")
    run = study.TRANSFORMS
    assert {r["lon_idx"]: r["permafrost_extent"] for r in run["permafrost_extent"](df, threshold=0.5).collect()} == {0: 1.0, 1: None}
    got = {(r["lon_idx"], r["year"]): r["active_layer_thickness"] for r in run["active_layer_thickness"](df, threshold=0.5, depth_max=2.0).collect()}
    assert [got[0, y] for y in (2000, 2001, 2002)] == [0.0, 1.0, None] and got[1, 2000] is None
    slope = {r["lon_idx"]: r["tsl"] for r in run["depth_gradient"](df, varname="tsl").collect()}
    assert slope[1] == pytest.approx(-2.0)
    at = run["quantile"](df, varname="tsl", quantiles=[0.0, 1.0], dims=["time", "depth"]).where("lon_idx = 1").orderBy("quantile").collect()
    assert [r["tsl_quantile"] for r in at] == [288.0, 290.0]
    assert run["msftmz_to_rapid"](df) is df and run["runoff_sensitivity"](df) is df and run["ocean_heat_content"](df) is df
    labelled = run["apply_label"](df, label=spark.createDataFrame([(50.0, 12.0, "tundra"), (50.0, 28.0, "taiga")], "lat double, lon double, cover string"), key="cover")
    assert {(r["lon_idx"], r["cover"]) for r in labelled.collect()} == {(0, "tundra"), (1, "taiga")}


def test_daily_transforms(spark):
    rows = [(0, 0, 1.0, f"2001-0{m}-0{d} {h:02d}:00:00", 2001, m, (d - 2) * 1e-5 + h * 1e-9) for m in (1, 2) for d in range(1, 6) for h in (0, 12)]
    df = spark.createDataFrame(rows, "lat_idx int, lon_idx int, area double, t string, year int, month int, pr double").withColumn("time", F.to_timestamp("t")).drop("t")
    df = with_units(df, "pr", "kg m-2 s-1")
    wet = study.TRANSFORMS["count_wet_days"](df).orderBy("month").collect()
    assert [r["wet_days"] for r in wet] == [2.0, 2.0]  # 1 mm a day is 1.157e-5 kg m-2 s-1
    agg = study.TRANSFORMS["agg_time_on_condition"](df, condname="some", cond="pr > 0 [mm/day]", agg="mean").collect()
    assert [r["some"] for r in agg] == [pytest.approx(14 / 20)]
    assert study.TRANSFORMS["count_frost_days"](df) is df
    masked = study.TRANSFORMS["mask_condition"](df, condition="pr >= 1 [mm/day]")
    assert masked.where("pr is null").count() == 8 and masked.schema["pr"].metadata == {"units": "kg m-2 s-1"}


def test_scalar_analyses(spark):
    ref, twice = _cube(spark, 1.0, "g m-2 d-1"), _cube(spark, 2.0, "g m-2 d-1")
    names = ["Spatial Distribution", "Area", "Net Biome Production", "Time Series", "Dispersion", "Runoff Sensitivity", "Relationship"]
    driven = lambda df, k: with_units(df.withColumn("tas", F.col("gpp") * k), "gpp", "g m-2 d-1")
    out = study.run_block(driven(ref, 1.0), {"same": driven(ref, 1.0), "twice": driven(twice, 1.0)}, "gpp", chosen=names, related=("tas",)).collect()
    got = {(r["source"], r["analysis"], r["name"]): r["value"] for r in out}
    assert got["same", "Spatial Distribution", "Spatial Distribution Score [1]"] == pytest.approx(1.0)
    assert got["twice", "Spatial Distribution", "Normalized Standard Deviation [1]"] == pytest.approx(2.0)
    assert got["same", "Relationship", "gpp/tas Score [1]"] == pytest.approx(1.0)
    assert got["twice", "Area", "Missed Score [1]"] == pytest.approx(1.0) and got["twice", "Area", "Overlap Area [Mm2]"] == pytest.approx(6e-12)
    assert got["same", "Net Biome Production", "Difference Score [1]"] == pytest.approx(1.0) and got["twice", "Net Biome Production", "Difference Score [1]"] < 0.6
    assert not {a for _, a, _ in got} & {"Time Series", "Dispersion", "Runoff Sensitivity"}
    series = with_units(ref.groupBy("year", "month").agg(F.avg("gpp").alias("gpp")), "gpp", "g m-2 d-1")
    out = study.run_block(series, {"same": series}, "gpp", chosen=["Time Series"]).collect()
    assert {r["name"]: r["value"] for r in out}["Taylor Score [1]"] == pytest.approx(1.0)


def test_streamed_windows(spark, tmp_path):
    path = f"{tmp_path}/in"
    spark.sql("SELECT timestamp'2020-01-01 06:00:00' AS ts, 1 AS k, 4.0D AS value UNION ALL SELECT timestamp'2020-01-01 18:00:00', 1, -2.0D UNION ALL SELECT timestamp'2020-01-09 00:00:00', 1, 0.0D").write.parquet(path)
    for n, made in enumerate((lambda s: windowed_mean(s, ["k"], "ts", "1 day", "1 day"), lambda s: daily_flags(s, ["k"], "ts", "frost_days", "1 day"))):
        stream = made(spark.readStream.schema("ts timestamp, k int, value double").parquet(path))
        stream.writeStream.format("memory").queryName(f"streamed{n}").option("checkpointLocation", f"{tmp_path}/c{n}").trigger(availableNow=True).start().awaitTermination(120)
    assert [r["value"] for r in spark.table("streamed0").orderBy("start").collect()][:1] == [1.0]
    assert [r["frost_days"] for r in spark.table("streamed1").orderBy("day").collect()][:1] == [True]
