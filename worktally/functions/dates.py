"""Dates from spreadsheet and statistics-package serial numbers and mixed text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from worktally.functions.scalars import as_col

# Day zero of each serial-number system and the day number of
# 1970-01-01 in it.
MODERN_EPOCH = "1899-12-30"
MODERN_EPOCH_BEFORE_MARCH_1900 = "1899-12-31"
MODERN_UNIX_DAY = 25569
FALSE_LEAP_DAY = 60
MAC_EPOCH = "1904-01-01"
MAC_UNIX_DAY = 24107
SAS_EPOCH = "1960-01-01"
SAS_UNIX_SECONDS = 315619200

DEFAULT_TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "yyyy-MM-dd'T'HH:mm:ss",
)


#: Serial of 31 December 9999; as far back there is no date of year 1 or later either.
LAST_SERIAL = 2_958_465
#: Text that is a serial number; a cast alone would also read "5d" and "Infinity".
SERIAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def serial_of(text: Column) -> Column:
    """The number that a text spells out, missing for any other text."""
    return F.when(text.rlike(SERIAL), text.try_cast("double"))


def _at(epoch: str, days: Column) -> Column:
    return F.date_add(F.lit(epoch).cast("date"), days.cast("int"))


def _in_zone(wall: Column, tz: str | None) -> Column:
    """Instant of a wall-clock time; missing where the zone skips that time."""
    if tz is None:
        return wall
    instant = F.to_utc_timestamp(wall, tz)
    return F.when(F.from_utc_timestamp(instant, tz) == wall, instant)


def excel_date(
    serial: Column | str,
    system: str = "modern",
    include_time: bool = False,
    round_seconds: bool = True,
    tz: str | None = None,
) -> Column:
    """Spreadsheet serial number to date, or to timestamp with ``include_time``.

    The modern system pretends that 29 February 1900 existed: that day becomes
    missing and serials before it are one day further on. NaN, infinite numbers and serials
    beyond the year 9999 are missing.
    """
    n = as_col(serial).cast("double")
    # Beyond the calendar's years 1 to 9999, and for NaN, there is no date.
    n = F.when(F.abs(n) <= LAST_SERIAL, n)
    day = F.floor(n)
    if system == "modern":
        unix_day = F.when(day > FALSE_LEAP_DAY, n - MODERN_UNIX_DAY).when(
            day < FALSE_LEAP_DAY, n - (MODERN_UNIX_DAY - 1)
        )
        date = F.when(day > FALSE_LEAP_DAY, _at(MODERN_EPOCH, day)).when(
            day < FALSE_LEAP_DAY, _at(MODERN_EPOCH_BEFORE_MARCH_1900, day)
        )
    elif system == "mac pre-2011":
        unix_day, date = n - MAC_UNIX_DAY, _at(MAC_EPOCH, day)
    else:
        raise ValueError(f"unknown date system {system!r}")
    if not include_time:
        return date
    seconds = unix_day * 86400
    if round_seconds:
        return _in_zone(F.timestamp_seconds(F.round(seconds, 0).cast("bigint")), tz)
    return _in_zone(F.timestamp_micros(F.round(seconds * 1000000, 0).cast("bigint")), tz)


def sas_date(days: Column | str) -> Column:
    """Days since 1960-01-01 to date."""
    return _at(SAS_EPOCH, F.floor(as_col(days)))


def sas_timestamp(seconds: Column | str) -> Column:
    """Seconds since 1960-01-01 to timestamp."""
    return F.timestamp_seconds(as_col(seconds) - SAS_UNIX_SECONDS)


def sas_time(seconds: Column | str) -> Column:
    """Seconds since midnight to a day-time interval."""
    return F.make_dt_interval(secs=as_col(seconds).cast("decimal(18,6)"))


def to_timestamp_mixed(
    text: Column | str,
    system: str = "modern",
    formats: Sequence[str] = DEFAULT_TIMESTAMP_FORMATS,
    tz: str | None = None,
) -> Column:
    """Serial numbers, dates and date-times in one text column to timestamp."""
    text = F.trim(as_col(text).cast("string"))
    parsed = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(
        excel_date(serial_of(text), system, include_time=True, tz=tz),
        text.try_cast("date").cast("timestamp") if not formats else parsed[0],
        *parsed[1:],
        text.try_cast("timestamp"),
    )


def to_date_mixed(
    text: Column | str, system: str = "modern", formats: Sequence[str] = DEFAULT_TIMESTAMP_FORMATS
) -> Column:
    """Serial numbers, dates and date-times in one text column to date."""
    text = F.trim(as_col(text).cast("string"))
    return F.coalesce(
        excel_date(serial_of(text), system),
        text.try_cast("date"),
        *[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats],
    )
