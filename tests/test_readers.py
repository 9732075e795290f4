"""Parsers, quantiles of t, and choices among catalogued files."""

import pytest

from gridloom.functions.expressions import FormulaError, condition, formula, quantity
from gridloom.functions.student import two_sided
from gridloom.functions.units import UnitError
from gridloom.operators import introspect, reports


@pytest.mark.parametrize("text,want", [("v < 3", ("v", "lt", "3")), ("v<=3", ("v", "le", "3")), ("v lt 3", ("v", "lt", "3")), ("v .ge. 1 [mm d-1]", ("v", "ge", "1 [mm d-1]")), ("felt == 0", ("felt", "eq", "0"))])
def test_conditions(text, want):
    assert condition(text) == want


@pytest.mark.parametrize("text", ["v", "< 3", "v <", ""])
def test_no_conditions(text):
    with pytest.raises(FormulaError):
        condition(text)


def test_quantities():
    assert quantity("1 [mm d-1]") == quantity("1[mm d-1]") == (1.0, "mm d-1")
    for bad in ("1", "1 (mm d-1)", "1 {mm d-1}", "[mm d-1]", "1 []", "x [m]"):
        with pytest.raises(FormulaError):
            quantity(bad)


def test_formula_follows_units(spark):
    row = spark.createDataFrame([(2.0, 500.0, 0.0)], "km double, m double, z double")
    name, column, unit, read = formula("d = km + m", {"km": "km", "m": "m"})
    assert name == "d" and read == {"km", "m"} and unit.factor == 1000
    assert row.select(column).first()[0] == 2.5
    assert row.select(formula("q = km / z")[1]).first()[0] is None
    assert row.select(formula("q = -km ** 2 * 3")[1]).first()[0] == -12.0
    with pytest.raises(UnitError):
        formula("d = km + z", {"km": "km", "z": "s"})
    for bad in ("d = __import__('os')", "d = a.b", "d = [a]", "d", "d = a if b else c", "d = a ** b"):
        with pytest.raises(FormulaError):
            formula(bad)


@pytest.mark.parametrize("freedom,want", [(1, 12.7062047), (2, 4.3026527), (5, 2.5705818), (10, 2.2281389), (30, 2.0422725), (120, 1.9799304)])
def test_t_quantiles(freedom, want):
    assert two_sided(0.95, freedom) == pytest.approx(want, rel=1e-7)


def test_dimensions():
    assert introspect.dimension(["time", "Latitude", "lon", "lndgrid"], "lat") == "Latitude"
    assert introspect.dimension(["time", "lndgrid"], "site") == "lndgrid"
    with pytest.raises(KeyError):
        introspect.dimension(["lat", "Lat"], "lat")


def test_members_and_grids(spark):
    rows = [("m", "r1", "gn", "a", "x1"), ("m", "r1", "gn", "b", "x2"), ("m", "r2", "gn", "a", "x3"), ("n", "r1", "gn", "a", "x4"), ("n", "r1", "gr", "a", "x5")]
    catalog = spark.createDataFrame(rows, "source_id string, member_id string, grid_label string, variable_id string, path string")
    paths = lambda df: sorted(r["path"] for r in df.collect())
    assert paths(reports.largest_members(catalog)) == ["x1", "x2", "x4", "x5"]
    assert paths(reports.regridded_first(catalog)) == ["x1", "x2", "x3", "x5"]
