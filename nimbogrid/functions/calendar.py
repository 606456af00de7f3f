"""Dates, day numbers, units of time and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days since which UTC has one more leap second, from 1993 on.
LEAPS = [
    "1993-07-01", "1994-07-01", "1996-01-01", "1997-07-01", "1999-01-01", "2006-01-01", "2009-01-01", "2012-07-01", "2015-07-01", "2017-01-01",
]

#: Seconds of a unit.
UNITS = {"msec": 0.001, "sec": 1.0, "min": 60.0, "hour": 3600.0, "day": 86400.0}


def day_number(d: Column) -> Column:
    """Days since 1970-01-01."""
    return F.date_diff(d.cast("date"), F.lit("1970-01-01").cast("date"))


def modified_julian_day(d: Column) -> Column:
    return F.date_diff(d.cast("date"), F.lit("1858-11-17").cast("date"))


def day_of_year(d: Column) -> Column:
    return F.dayofyear(d)


def month_days(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d.cast("date")))


def is_leap(d: Column) -> Column:
    y = F.year(d)
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def day_360(d: Column) -> Column:
    """Day number of a calendar with twelve months of 30 days."""
    return F.year(d) * 360 + (F.month(d) - 1) * 30 + F.least(F.dayofmonth(d), F.lit(30)) - 1


def label(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd-HHmmss")


def to_seconds(n: Column, unit: Column) -> Column:
    """Seconds of n units; missing for an unknown unit."""
    out = F.lit(None).cast("double")
    for name, seconds in UNITS.items():
        out = F.when(F.lower(unit) == name, n * seconds).otherwise(out)
    return out


def from_seconds(seconds: Column, unit: Column) -> Column:
    return F.try_divide(seconds, to_seconds(F.lit(1.0), unit))


def cf_time(value: Column, units: Column) -> Column:
    """Timestamp of a number in units such as 'hours since 2000-01-01 00:00:00'."""
    unit = F.regexp_replace(F.lower(F.regexp_extract(units, r"^\s*(\w+?)s?\s+since", 1)), "^(second|minute)$", "")
    name = F.when(unit != "", unit).otherwise(F.when(F.lower(units).startswith("minute"), "min").otherwise("sec"))
    epoch = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(units, r"since\s+(.+?)\s*$", 1), "T", " "))
    return F.timestamp_micros((F.unix_micros(epoch) + to_seconds(value, name) * 1e6).cast("long"))


def add_seconds(d: Column, seconds: Column) -> Column:
    return d + F.make_dt_interval(secs=seconds)


def jst_to_utc(d: Column) -> Column:
    return d - F.expr("INTERVAL 9 HOURS")


def utc_to_tai93(d: Column) -> Column:
    """Seconds since 1993-01-01 with leap seconds counted."""
    day = F.lit("1993-01-01").cast("timestamp_ntz")
    seconds = F.timestamp_diff("MICROSECOND", day, d) / F.lit(1e6)
    leaps = F.lit(0)
    for x in LEAPS:
        leaps = leaps + F.when(d >= F.lit(x).cast("timestamp_ntz"), 1).otherwise(0)
    return seconds + leaps
