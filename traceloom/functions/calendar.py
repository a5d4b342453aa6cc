"""Working-time arithmetic as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import Calendar

MICROS_HOUR = 3_600_000_000
_MICROS_DAY = 24 * MICROS_HOUR
_MONDAY = 4 * _MICROS_DAY  # 1970-01-05, the first Monday after the epoch


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed hours between two timestamps."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(MICROS_HOUR))


def plus_micros(ts: Column, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + micros.cast("long"))


def wall_micros(ts: Column, zone: str) -> Column:
    """Wall-clock microseconds in the zone, counted as if the clock were UTC."""
    return F.unix_micros(ts if zone.upper() == "UTC" else F.from_utc_timestamp(ts, zone))


def _worked(wall: Column, cal: Calendar) -> Column:
    """Working microseconds from a fixed Monday up to a wall-clock instant."""
    since = wall - F.lit(_MONDAY)
    day = F.floor(since / F.lit(_MICROS_DAY))
    # exact integer remainder: the division above is floating point, but only its floor is used
    clock = F.pmod(since, F.lit(_MICROS_DAY))
    full = (cal.end_hour - cal.start_hour) * MICROS_HOUR
    today = F.greatest(
        F.lit(0), F.least(clock - F.lit(cal.start_hour * MICROS_HOUR), F.lit(full))
    )
    if not cal.skip_weekends:
        return day * F.lit(full) + today
    weeks, weekday = F.floor(day / F.lit(7)), F.pmod(day, F.lit(7))
    days = weeks * 5 + F.least(weekday, F.lit(5))
    return days * F.lit(full) + F.when(weekday < 5, today).otherwise(F.lit(0))


def worked_micros(ts: Column, cal: Calendar) -> Column:
    """Working microseconds from a fixed Monday to ts: differences give working time."""
    return _worked(wall_micros(ts, cal.zone), cal)


def business_micros(start: Column, end: Column, cal: Calendar) -> Column:
    """Working microseconds in [start, end); integers, so sums are exact."""
    return F.when(end >= start, worked_micros(end, cal) - worked_micros(start, cal))


def business_hours(start: Column, end: Column, cal: Calendar) -> Column:
    """Working hours in [start, end): the difference of two cumulative counts.

    Needs no day array, so a long interval costs what a short one costs.  Both
    ends are read on the wall clock of the zone.  A reversed interval gives null.
    """
    return business_micros(start, end, cal) / F.lit(float(MICROS_HOUR))


def business_hours_by_day(start: Column, end: Column, cal: Calendar) -> Column:
    """The same measure summed day by day; kept as an independent check."""
    begin, finish = wall_micros(start, cal.zone), wall_micros(end, cal.zone)
    first = F.floor(begin / F.lit(_MICROS_DAY))
    last = F.floor(finish / F.lit(_MICROS_DAY))

    def overlap(day: Column) -> Column:
        opens = day * F.lit(_MICROS_DAY) + F.lit(cal.start_hour * MICROS_HOUR)
        closes = day * F.lit(_MICROS_DAY) + F.lit(cal.end_hour * MICROS_HOUR)
        got = F.greatest(F.lit(0), F.least(finish, closes) - F.greatest(begin, opens))
        weekday = F.pmod(day + 3, F.lit(7))  # day 0 is a Thursday
        return F.when(weekday < 5, got).otherwise(F.lit(0)) if cal.skip_weekends else got

    total = F.aggregate(
        F.sequence(first, last), F.lit(0).cast("long"), lambda acc, d: acc + overlap(d)
    )
    return F.when(end >= start, total / F.lit(float(MICROS_HOUR)))
