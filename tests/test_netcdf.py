"""Calendars, and a classic file written byte by byte."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.calendars import days_of_month, decode
from gridloom.sources.catalog import units_of
from gridloom.sources.netcdf import read_netcdf


@pytest.mark.parametrize(
    "value,units,calendar,want",
    [
        (59.0, "days since 2000-01-01", "noleap", (2000, 3, 1)),
        (59.0, "days since 2000-01-01", "standard", (2000, 2, 29)),
        (59.0, "days since 2001-01-01", "all_leap", (2001, 2, 29)),
        (59.5, "days since 2000-01-01", "360_day", (2000, 2, 30)),
        (-1.0, "days since 1850-01-01 00:00", "365_day", (1849, 12, 31)),
        (36.0, "hours since 1999-12-31 12:00:00", "gregorian", (2000, 1, 2)),
    ],
)
def test_decoding(spark, value, units, calendar, want):
    assert tuple(spark.range(1).select(*decode(F.lit(value), units, calendar)).first()) == want


def test_bad_times(spark):
    for units, calendar in (("months since 2000-01-01", "standard"), ("days since 2000-01-01", "lunar")):
        with pytest.raises(ValueError):
            decode(F.lit(1.0), units, calendar)


def test_month_lengths(spark):
    row = spark.range(1).select(*(days_of_month(F.lit(2000), F.lit(2), c) for c in ("standard", "noleap", "360_day"))).first()
    assert tuple(row) == (29.0, 28.0, 30.0)


def _classic(values: np.ndarray) -> bytes:
    """time (records) x lat, as the format's description lays it out."""
    n32 = lambda *x: struct.pack(f">{len(x)}i", *x)
    text = lambda s: n32(len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    words = lambda name, s: text(name) + n32(2) + text(s)

    def head(b_lat: int, b_time: int, b_v: int) -> bytes:
        out = b"CDF\x01" + n32(values.shape[0]) + n32(10, 2) + text("time") + n32(0) + text("lat") + n32(values.shape[1]) + n32(0, 0)
        out += n32(11, 3) + text("lat") + n32(1, 1) + n32(0, 0) + n32(6, 8 * values.shape[1], b_lat)
        out += text("time") + n32(1, 0) + n32(12, 2) + words("units", "days since 2000-01-01") + words("calendar", "noleap") + n32(6, 8, b_time)
        out += text("tas") + n32(2, 0, 1) + n32(12, 2) + words("units", "K") + text("_FillValue") + n32(5, 1) + struct.pack(">f", -999.0)
        return out + n32(5, 4 * values.shape[1], b_v)

    size = len(head(0, 0, 0))
    lat = np.linspace(-45, 45, values.shape[1]).astype(">f8").tobytes()
    records = b"".join(struct.pack(">d", 31.0 * k) + v.astype(">f4").tobytes() for k, v in enumerate(values))
    return head(size, size + len(lat), size + len(lat) + 8) + lat + records


def test_classic_file(spark, tmp_path):
    values = np.array([[1.5, 2.5, -999.0], [4.5, 5.5, 6.5]])
    (tmp_path / "tas.nc").write_bytes(_classic(values))
    df = read_netcdf(spark, f"{tmp_path}/tas.nc", "tas")
    got = [(r["time_idx"], r["lat"], r["year"], r["month"], r["tas"]) for r in df.orderBy("time_idx", "lat_idx").collect()]
    assert got == [(k, lat, 2000, k + 1, None if v == -999 else v) for k in range(2) for lat, v in zip((-45.0, 0.0, 45.0), values[k], strict=True)]
    assert units_of(df, "tas") == "K"
    with pytest.raises(KeyError):
        read_netcdf(spark, f"{tmp_path}/tas.nc", "pr")
