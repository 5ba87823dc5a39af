"""Checks that ride along with the one job that writes the data.

Counts of what is wrong are observed metrics: they are gathered while the rows pass by, so a report costs no pass of its own.
The rows are written once to the shared folder; what follows reads the copy.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from worktally.functions import dates
from worktally.operators.cleaning import is_missing
from worktally.session import stored


class RejectedValues(ValueError):
    """Values that a strict check does not accept; ``counts`` says how many of what."""

    def __init__(self, counts: Mapping[str, int]):
        super().__init__("rejected values: " + ", ".join(f"{k} {n}" for k, n in counts.items() if n))
        self.counts = dict(counts)


def observed(df: DataFrame, label: str, counts: Mapping[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """Store a table and count, in the same pass, the rows for which each condition holds (missing conditions do not)."""
    watch = Observation()
    names = list(counts)
    metrics = [F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(counts.values())]]
    copy = stored(df.observe(watch, *metrics), label)
    seen = watch.get
    return copy, {"rows": int(seen.get("rows") or 0)} | {name: int(seen.get(f"c{i}") or 0) for i, name in enumerate(names)}


@dataclass(frozen=True)
class Gate:
    """Rows that passed, rows that did not, and the counts: ``rows``, ``rejected`` and the missing values of each column."""

    accepted: DataFrame
    rejected: DataFrame
    counts: dict[str, int] = field(default_factory=dict)


def quality_report(df: DataFrame, required: Sequence[str], strict: bool = False) -> Gate:
    """Split rows by whether every required value is there, reading the input once; NaN counts as missing.

    ``strict`` raises ``RejectedValues`` if any row is rejected.
    """
    missing = {c: is_missing(df, c) for c in required}
    incomplete = F.lit(False)
    for c in missing.values():
        incomplete = incomplete | c
    flagged = df.withColumn("__rejected", incomplete)
    copy, counts = observed(flagged, "gate", {"rejected": F.col("__rejected")} | {f"missing {c}": is_missing(flagged, c) for c in required})
    if strict and counts["rejected"]:
        raise RejectedValues({k: n for k, n in counts.items() if k != "rows"})
    return Gate(copy.filter(~F.col("__rejected")).drop("__rejected"), copy.filter("__rejected").drop("__rejected"), counts)


@dataclass(frozen=True)
class DatesRead:
    """The table with its dates, and for each of the columns what could not be read as one."""

    table: DataFrame
    counts: dict[str, dict[str, int]]

    def report(self) -> DataFrame:
        """One row for each column: ``column_name``, ``rows`` and the counts."""
        rows = [(c, *(n[k] for k in REPORTED)) for c, n in self.counts.items()]
        return self.table.sparkSession.createDataFrame(rows, "column_name string, " + ", ".join(f"{k} bigint" for k in REPORTED))


REPORTED = ["rows", "missing", "unreadable", "not_positive", "no_such_day", "skipped_hour"]


def read_dates(
    df: DataFrame,
    columns: Mapping[str, str],
    include_time: bool = False,
    system: str = "modern",
    formats: Sequence[str] = dates.DEFAULT_TIMESTAMP_FORMATS,
    tz: str | None = None,
    strict: bool = False,
) -> DatesRead:
    """Read columns of serial numbers, dates and date-times, numbers or mixed text, and report what is odd about them.

    ``columns`` gives for each column the name of the column to put its dates in. Counted are, besides all rows and missing values:
    values that are no date at all (``unreadable``), serial numbers below 1 (``not_positive``; the system starts at 1, but
    they are read), the day that never was (``no_such_day``, modern serial 60) and times that the zone ``tz`` skips
    (``skipped_hour``). The last two have no date either and are not among the unreadable. The
    report comes with the pass that stores the result. ``strict`` raises ``RejectedValues`` if any value is unreadable, of no such day or skipped.
    """
    found, checks = {}, {}
    for source, into in columns.items():
        text = F.trim(F.col(f"`{source}`").cast("string"))
        serial = dates.serial_of(text)
        if include_time:
            read, plain = (dates.to_timestamp_mixed(text, system, formats, zone) for zone in (tz, None))
        else:
            read = plain = dates.to_date_mixed(text, system, formats)
        no_day = F.coalesce(F.floor(serial) == dates.FALSE_LEAP_DAY, F.lit(False)) if system == "modern" else F.lit(False)
        found[into] = read
        checks[source] = {
            "missing": text.isNull(),
            "unreadable": text.isNotNull() & plain.isNull() & ~no_day,
            "not_positive": serial < 1,
            "no_such_day": no_day,
            "skipped_hour": plain.isNotNull() & read.isNull(),
        }
    # One projection: a column may be replaced by its dates, the checks still see what it held.
    marks = {f"__check_{i}_{j}": c for i, of in enumerate(checks.values()) for j, c in enumerate(of.values())}
    sources = df.withColumns(found | marks)
    watch = Observation()
    metrics = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(m)).alias(m) for m in marks]]
    copy = stored(sources.observe(watch, *metrics).drop(*marks), "dates")
    seen = watch.get
    rows = int(seen.get("rows") or 0)
    counts = {
        source: {"rows": rows} | {k: int(seen.get(f"__check_{i}_{j}") or 0) for j, k in enumerate(of)} for i, (source, of) in enumerate(checks.items())
    }
    if strict:
        bad = {f"{k} in {source}": n[k] for source, n in counts.items() for k in ("unreadable", "no_such_day", "skipped_hour")}
        if any(bad.values()):
            raise RejectedValues(bad)
    return DatesRead(copy, counts)
