"""Times as days since a date, in calendars of climate files."""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.measures import MONTH_DAYS, month_days

#: Names of calendars in files.
NAMES = {"noleap": "noleap", "365_day": "noleap", "all_leap": "all_leap", "366_day": "all_leap", "360_day": "360_day", "gregorian": "gregorian", "standard": "gregorian", "proleptic_gregorian": "gregorian"}
STEPS = {"day": 1.0, "hour": 1 / 24, "minute": 1 / 1440, "second": 1 / 86400}


def decode(value: Column, units: str, calendar: str = "standard") -> tuple[Column, Column, Column]:
    """Year, month and day of times like ``days since 1850-01-01``.

    Gregorian dates are proleptic; years before 1582 in mixed calendars are not
    told apart."""
    found = re.match(r"\s*(day|hour|minute|second)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T ]+(\d+):(\d+))?", units)
    if not found or calendar not in NAMES:
        raise ValueError(f"can't read times in {units!r} of calendar {calendar!r}")
    year, month, day, hour, minute = (int(x or 0) for x in found.groups()[1:])
    days = F.floor(F.round(value * STEPS[found[1]] + hour / 24 + minute / 1440, 9)).cast("int")
    kind = NAMES[calendar]
    if kind == "gregorian":
        at = F.date_add(F.make_date(F.lit(year), F.lit(month), F.lit(day)), days)
        return F.year(at), F.month(at), F.day(at)
    before = [0, *accumulate(MONTH_DAYS[kind])]
    at = days + (year * before[12] + before[month - 1] + day - 1)
    years = F.floor(at / before[12]).cast("int")
    in_year = at - years * before[12]
    months = F.lit(1)
    for start in before[1:12]:
        months = months + F.when(in_year >= start, 1).otherwise(0)
    return years, months, (in_year - F.element_at(F.array(*map(F.lit, before)), months) + 1).cast("int")


def days_of_month(year: Column, month: Column, calendar: str = "standard") -> Column:
    kind = NAMES[calendar]
    if kind == "gregorian":
        return F.day(F.last_day(F.make_date(year, month, F.lit(1)))).cast("double")
    return month_days(month, kind)
