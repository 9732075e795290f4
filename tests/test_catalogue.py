"""Some registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from gridloom.plans import catalogue_extra as catalogue

DATA = "/root/testdata/sf0.001"
TABLES = ["supplier", "nation", "customer", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"runoff_sensitivity"}


@pytest.mark.parametrize("name", ["bias_collier", "seasonal_mean", "nest_grids", "closest_site", "region_mask_box", "permafrost_extent", "rmse", "cycle_score", "count_wet_days", "nbp_scores", "frequency_label", "bbox_grid_nearest", "region_mask_raster", "same_grid_nearest", "cmec_means", "plot_limits", "relationship_score", "bias_uncertainty"])
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    want = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    key = lambda r: tuple(str(x) for x in r)
    mine = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    assert mine == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


def test_days_at_the_threshold(spark, tmp_path):
    days = [(1, 1, [15.45, 6.55]), (1, 2, [15.45, 6.54]), (2, 1, [11.0]), (2, 3, [10.99]), (3, 1, [35.0, 9.99]), (3, 2, [30.0]), (4, 5, [10.0, 10.01])]
    values = ", ".join(f"({u}, TIMESTAMP '2024-01-0{day} 0{i}:00:00', {v}e0)" for u, day, held in days for i, v in enumerate(held))
    con = duckdb.connect()
    con.sql(f"CREATE TABLE events AS SELECT * FROM (VALUES {values}) t(user_id, ts, value)")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    for name in ("count_wet_days", "count_summer_days", "count_ice_days", "count_tropical_nights", "count_frost_days"):
        got = catalogue.queries()[name](spark, str(tmp_path)).select("user_id", "year", "month", "days").collect()
        assert sorted(map(tuple, got)) == sorted(con.sql(catalogue.oracle_sql()[name]).fetchall()), name
