"""A small unit algebra: dimension vectors, factors and offsets.

Conversions are worked out on the driver and reach Spark as a factor and an
offset.  Mass and volume convert through the density of water.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.measures import WATER_DENSITY

BASE = ("kg", "m", "s", "K", "mol", "psu")


class UnitError(ValueError):
    """A unit that can't be read or converted."""


@dataclass(frozen=True)
class Unit:
    factor: float
    powers: tuple[int, ...]
    offset: float = 0.0

    def __mul__(self, other: Unit) -> Unit:
        return Unit(self.factor * other.factor, tuple(a + b for a, b in zip(self.powers, other.powers, strict=True)))

    def __pow__(self, n: int) -> Unit:
        return Unit(self.factor**n, tuple(a * n for a in self.powers))


def _unit(factor: float, offset: float = 0.0, **powers: int) -> Unit:
    return Unit(factor, tuple(powers.get(b, 0) for b in BASE), offset)


_UNITS = {
    "1": _unit(1), "%": _unit(0.01), "percent": _unit(0.01),
    "g": _unit(1e-3, kg=1), "gC": _unit(1e-3, kg=1), "t": _unit(1e3, kg=1),
    "m": _unit(1, m=1), "meter": _unit(1, m=1), "l": _unit(1e-3, m=3),
    "s": _unit(1, s=1), "min": _unit(60, s=1), "h": _unit(3600, s=1), "hr": _unit(3600, s=1),
    "d": _unit(86400, s=1), "day": _unit(86400, s=1), "yr": _unit(365.25 * 86400, s=1), "year": _unit(365.25 * 86400, s=1), "month": _unit(365.25 * 7200, s=1),
    "K": _unit(1, K=1), "degC": _unit(1, 273.15, K=1), "delta_degC": _unit(1, K=1),
    "W": _unit(1, kg=1, m=2, s=-3), "J": _unit(1, kg=1, m=2, s=-2), "Pa": _unit(1, kg=1, m=-1, s=-2), "N": _unit(1, kg=1, m=1, s=-2),
    "Sv": _unit(1e6, m=3, s=-1), "mol": _unit(1, mol=1), "psu": _unit(1, psu=1),
}
_PREFIXES = {"Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9, "mega": 1e6, "kilo": 1e3}
_TERM = re.compile(r"\s*(\*\*|[*/]|)\s*(?:\(([^()]*)\)|([A-Za-z_%]+|1))(?:\s*(?:\*\*|\^)?\s*(-?\d+))?")


def _named(name: str) -> Unit:
    if name in _UNITS:
        return _UNITS[name]
    for prefix, factor in _PREFIXES.items():
        if name.startswith(prefix) and (rest := name[len(prefix) :]) in _UNITS and rest not in ("1", "%", "degC"):
            return Unit(factor * _UNITS[rest].factor, _UNITS[rest].powers)
    raise UnitError(f"unknown unit {name!r}")


def parse(text: str) -> Unit:
    """Products of powers: ``kg m-2 s-1``, ``mm/day``, ``(kg)*(m2)``."""
    out, at, terms = _unit(1), 0, 0
    text = text.strip() or "1"
    while at < len(text):
        found = _TERM.match(text, at)
        if not found or found.end() == at:
            raise UnitError(f"can't read {text!r} at {text[at:]!r}")
        sign, group, name, power = found.groups()
        part = parse(group) if group is not None else _named(name)
        n = int(power or 1) * (-1 if sign == "/" else 1)
        keeps_offset = terms == 0 and n == 1 and found.end() == len(text)
        out = part if keeps_offset else out * part**n
        at, terms = found.end(), terms + 1
    return out


def conversion(source: str, target: str) -> tuple[float, float]:
    """``value * factor + offset`` takes values in ``source`` to ``target``."""
    a, b = parse(source), parse(target)
    factor = a.factor / b.factor
    if a.powers != b.powers:
        apart = tuple(x - y for x, y in zip(a.powers, b.powers, strict=True))
        mass_per_volume = parse("kg m-3").powers
        if apart == mass_per_volume:
            factor /= WATER_DENSITY
        elif tuple(-x for x in apart) == mass_per_volume:
            factor *= WATER_DENSITY
        else:
            raise UnitError(f"can't convert {source!r} to {target!r}")
    return factor, (a.offset - b.offset) / b.factor if a.offset or b.offset else 0.0


def convert(value: Column, source: str, target: str) -> Column:
    factor, offset = conversion(source, target)
    return value * F.lit(factor) + F.lit(offset)
