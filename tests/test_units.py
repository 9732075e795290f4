import pytest

from gridloom.functions.units import UnitError, conversion


@pytest.mark.parametrize(
    "source,target,factor,offset",
    [
        ("kg m-2 s-1", "g m-2 d-1", 86400e3, 0),
        ("degC", "K", 1, 273.15),
        ("K", "degC", 1, -273.15),
        ("kg m-2 s-1", "mm/day", 86400 * 1000 / 998.2071, 0),
        ("kg s-1", "Sv", 1e-6 / 998.2071, 0),
        ("kg m-2", "m", 1 / 998.2071, 0),
        ("m", "kg m-2", 998.2071, 0),
        ("(kg m-2 s-1)*(m2)", "kg s-1", 1, 0),
        ("J", "ZJ", 1e-21, 0),
        ("megameter**2", "m2", 1e12, 0),
        ("delta_degC km-1", "K m-1", 1e-3, 0),
        ("%", "1", 0.01, 0),
    ],
)
def test_conversions(source, target, factor, offset):
    f, o = conversion(source, target)
    assert f == pytest.approx(factor, rel=1e-12) and o == pytest.approx(offset, abs=1e-9)


@pytest.mark.parametrize("source,target", [("kg", "m"), ("kg", "furlong"), ("K", "s")])
def test_what_does_not_convert(source, target):
    with pytest.raises(UnitError):
        conversion(source, target)
