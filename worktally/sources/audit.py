"""Do feeds agree in names and types, and would their values fit together."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Type names that count as numbers.
INTEGRAL = {"tinyint", "smallint", "int", "bigint"}
FRACTIONAL = {"float", "double"}

MODES = ("by_name", "strict")


def type_labels(feeds: Mapping[str, DataFrame]) -> dict[str, dict[str, str | None]]:
    """Type of every column in every feed, None where it is absent. No job."""
    names = list(dict.fromkeys(c for df in feeds.values() for c in df.columns))
    return {c: {f: dict(df.dtypes).get(c) for f, df in feeds.items()} for c in names}


def common_type(types: set[str]) -> str:
    """Type all values should be readable as."""
    specific = types - {"string"} or types
    if len(specific) == 1:
        return next(iter(specific))
    if specific <= INTEGRAL:
        return "bigint"
    if specific <= INTEGRAL | FRACTIONAL:
        return "double"
    return "string"


def _agrees(types: Mapping[str, str | None], mode: str) -> bool:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    present = {t for t in types.values() if t}
    return len(present) == 1 and (mode == "by_name" or None not in types.values())


def feeds_match(feeds: Mapping[str, DataFrame], mode: str = "by_name") -> bool:
    """Can the feeds be stacked: same type wherever a column occurs, and with
    ``strict`` the same columns everywhere."""
    return all(_agrees(types, mode) for types in type_labels(feeds).values())


def compare_columns(feeds: Mapping[str, DataFrame], show: str = "all", mode: str = "by_name") -> DataFrame:
    """One row per column, one type label per feed; all, match or mismatch only."""
    spark = next(iter(feeds.values())).sparkSession
    rows = [
        (c, *types.values())
        for c, types in sorted(type_labels(feeds).items())
        if show == "all" or _agrees(types, mode) == (show == "match")
    ]
    return spark.createDataFrame(rows, ", ".join(["column_name string", *[f"`{f}` string" for f in feeds]]))


def audit_feeds(feeds: Mapping[str, DataFrame], show: str = "all", mode: str = "by_name") -> DataFrame:
    """Per feed and column: type, common type, values, values that do not fit it.

    One aggregate pass per feed returns one row; absent columns have no type.
    """
    labels = type_labels(feeds)
    wanted = {c: t for c, t in labels.items() if show == "all" or _agrees(t, mode) == (show == "match")}
    parts = []
    for feed, df in feeds.items():
        cells = []
        for c, types in wanted.items():
            goal = common_type({t for t in types.values() if t})
            there = types[feed] is not None
            value = F.col(c) if there else F.lit(None)
            cells.append(
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.lit(types[feed]).cast("string").alias("type"),
                    F.lit(goal).alias("common_type"),
                    F.lit(_agrees(types, mode)).alias("agrees"),
                    F.count(value).alias("n_values"),
                    F.count_if(value.isNotNull() & value.try_cast(goal).isNull()).alias("n_misfits"),
                )
            )
        if cells:
            parts.append(df.agg(F.array(*cells).alias("a")).select(F.lit(feed).alias("feed"), F.inline("a")))
    if not parts:
        spark = next(iter(feeds.values())).sparkSession
        return spark.createDataFrame(
            [], "feed string, column_name string, type string, common_type string, agrees boolean, n_values bigint, n_misfits bigint"
        )
    return reduce(DataFrame.unionByName, parts)
