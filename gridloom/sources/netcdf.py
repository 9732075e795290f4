"""Variables of classic NetCDF files (CDF-1 and CDF-2) as long tables.

Files come through Spark's binary reader, so they may be in any store it reads;
each is one row of at most 2 GB, read by one task and given out in pieces.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from gridloom.functions.calendars import decode

#: Fixed values of the format: types by code.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
#: Values in one piece.
PIECE = 500_000


class _Reader:
    def __init__(self, data: bytes, wide: bool) -> None:
        self.data, self.at, self.wide = data, 4, wide

    def number(self, code: str = ">i") -> int:
        value = struct.unpack_from(code, self.data, self.at)[0]
        self.at += struct.calcsize(code)
        return value

    def padded(self, size: int) -> bytes:
        value = self.data[self.at : self.at + size]
        self.at += -(-size // 4) * 4
        return value

    def name(self) -> str:
        return self.padded(self.number()).decode()

    def several(self, read) -> list:
        self.number()  # the tag
        return [read() for _ in range(self.number())]

    def attribute(self) -> tuple[str, object]:
        name, kind, n = self.name(), self.number(), self.number()
        raw = self.padded(n * np.dtype(TYPES[kind]).itemsize)
        if kind == 2:
            return name, raw.decode("utf-8", "replace")
        values = np.frombuffer(raw, TYPES[kind]).tolist()
        return name, values[0] if n == 1 else values

    def variable(self) -> dict:
        name, dims = self.name(), [self.number() for _ in range(self.number())]
        attrs, kind, size = dict(self.several(self.attribute)), self.number(), self.number()
        return {"name": name, "dims": dims, "attrs": attrs, "type": kind, "size": size, "begin": self.number(">q" if self.wide else ">i")}


def header(data: bytes) -> dict:
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise ValueError("not a classic NetCDF file")
    r = _Reader(data, data[3] == 2)
    records = r.number()
    dims = r.several(lambda: (r.name(), r.number()))
    r.several(r.attribute)
    variables = r.several(r.variable)
    moving = [v for v in variables if v["dims"] and dims[v["dims"][0]][1] == 0]
    stride = sum(v["size"] for v in moving)
    if len(moving) == 1:  # the one record variable is not padded
        v = moving[0]
        stride = int(np.prod([dims[d][1] for d in v["dims"][1:]])) * np.dtype(TYPES[v["type"]]).itemsize
    shape = lambda v: [records if dims[d][1] == 0 else dims[d][1] for d in v["dims"]]
    return {"variables": {v["name"]: v | {"shape": shape(v), "dims": [dims[d][0] for d in v["dims"]], "stride": stride if v in moving else None} for v in variables}}


def values(data: bytes, v: dict, lo: int, hi: int) -> np.ndarray:
    """Entries ``lo`` to ``hi`` along the first dimension; missing ones as NaN."""
    kind, inner = np.dtype(TYPES[v["type"]]), int(np.prod(v["shape"][1:]))
    if v["stride"] is None:
        raw = np.frombuffer(data, kind, (hi - lo) * inner, v["begin"] + lo * inner * kind.itemsize)
    else:
        raw = np.concatenate([np.frombuffer(data, kind, inner, v["begin"] + k * v["stride"]) for k in range(lo, hi)])
    out = raw.astype(float)
    for name in ("_FillValue", "missing_value"):
        if name in v["attrs"]:
            out[raw == np.asarray(v["attrs"][name], raw.dtype)] = np.nan
    return out * v["attrs"].get("scale_factor", 1.0) + v["attrs"].get("add_offset", 0.0)


def read_netcdf(spark: SparkSession, paths: str | list[str], variable: str) -> DataFrame:
    """``variable`` with an index ``<dim>_idx`` and, where the file has it, the
    coordinate ``<dim>`` of each dimension; ``year``, ``month`` and ``day`` of
    decoded times; the unit as metadata.  Fill values are NULL.  Files have the
    same dimensions; the first header is taken for all attributes."""
    files = spark.read.format("binaryFile").load(paths).select("content")

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                yield pd.DataFrame({"head": [json.dumps(header(data))]})

    known = json.loads(files.limit(1).mapInPandas(heads, "head string").first()["head"])["variables"]
    if variable not in known or not known[variable]["dims"]:
        raise KeyError(f"no variable {variable!r} with dimensions among {sorted(known)}")
    dims = known[variable]["dims"]
    held = [d for d in dims if d in known and known[d]["dims"] == [d]]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                every = header(data)["variables"]
                v = every[variable]
                axes = {d: values(data, every[d], 0, every[d]["shape"][0]) for d in held}
                step = max(1, PIECE // max(1, int(np.prod(v["shape"][1:]))))
                for lo in range(0, v["shape"][0], step):
                    hi = min(lo + step, v["shape"][0])
                    at = np.unravel_index(np.arange((hi - lo) * int(np.prod(v["shape"][1:]))), (hi - lo, *v["shape"][1:]))
                    index = {d: a + (lo if k == 0 else 0) for k, (d, a) in enumerate(zip(dims, at, strict=True))}
                    out = {f"{d}_idx": i.astype("int32") for d, i in index.items()} | {d: axes[d][index[d]] for d in held}
                    found = pd.array(values(data, v, lo, hi), dtype="Float64")
                    found[np.isnan(found.to_numpy(float, na_value=np.nan))] = pd.NA
                    yield pd.DataFrame(out | {variable: found})

    schema = ", ".join([*(f"`{d}_idx` int" for d in dims), *(f"`{d}` double" for d in held), f"`{variable}` double"])
    out = files.mapInPandas(rows, schema)
    if "time" in held and "since" in (units := known["time"]["attrs"].get("units", "")):
        year, month, day = decode(out["time"], units, known["time"]["attrs"].get("calendar", "standard"))
        out = out.withColumns({"year": year, "month": month, "day": day})
    return out.withMetadata(variable, {"units": known[variable]["attrs"].get("units", "1")})
