"""Totals, shares, rounding and cell text for any wide frame.

The first column names the rows; ``cols`` limits the columns that change,
numeric ones after the first by default.

``remembered`` makes a frame keep two things through all later steps, whatever happens to its rows in between: which
rows and columns are totals, and the counts its cells began with. Totals then stay out of the bases of shares, and ``adorn_ns`` needs no
second frame. A flag column holds the former, with the names of totals columns in its metadata, hidden columns hold the latter;
``plain`` takes both off.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktally.functions.scalars import format_count, format_share, rounder
from worktally.operators.cleaning import numeric_columns
from worktally.operators.joins import join_null_safe


#: The flag of totals rows and the prefix of remembered counts.
FLAG, CORE = "__totals_row", "__core_"


def _chosen(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    hidden = _hidden(df)
    return list(cols) if cols else [c for c in numeric_columns(df) if c != df.columns[0] and c not in hidden]


def _hidden(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == FLAG or c.startswith(CORE)] if FLAG in df.columns else []


def _total_columns(df: DataFrame) -> list[str]:
    """Names of the totals columns that a remembered frame has."""
    return df.schema[FLAG].metadata.get("total_columns", []) if FLAG in df.columns else []


def remembered(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A frame that keeps its counts and knows its totals; counts are the numeric columns or ``cols``."""
    counts = {CORE + c: F.col(f"`{c}`") for c in _chosen(df, cols)}
    return df.withColumns({FLAG: F.lit(False), **counts}).withMetadata(FLAG, {"total_columns": []})


def plain(df: DataFrame) -> DataFrame:
    """The frame without what it remembers."""
    return df.drop(*_hidden(df))


def adorn_totals(
    df: DataFrame,
    where: Sequence[str] | str = "row",
    fill: str | None = "-",
    na_rm: bool = True,
    name: str | Sequence[str] = "Total",
    cols: Sequence[str] | None = None,
) -> DataFrame:
    """Add a totals row, column or both.

    Cells of the totals row that are not totalled show ``fill`` as text, or stay
    missing in their own type with ``fill=None``. On a remembered frame earlier totals are no part of later ones.
    """
    where = (where,) if isinstance(where, str) else tuple(where)
    row_name, col_name = (name, name) if isinstance(name, str) else name
    cols, knows, marked = _chosen(df, cols), FLAG in df.columns, _total_columns(df)
    first = df.columns[0]

    def across(names: Sequence[str]) -> Column:
        parts = [F.coalesce(F.col(f"`{c}`"), F.lit(0)) if na_rm else F.col(f"`{c}`") for c in names]
        return sum(parts[1:], parts[0])

    if "col" in where:
        added = [c for c in cols if c not in marked]
        df = df.withColumn(col_name, across(added))
        counted = [CORE + c for c in added if CORE + c in df.columns] if knows else []
        if counted:
            df = df.withColumn(CORE + col_name, across(counted))
        cols, marked = [*cols, col_name], [*marked, col_name]
    if "row" not in where:
        return df.withMetadata(FLAG, {"total_columns": marked}) if knows else df
    hidden = _hidden(df)

    def total(c: str) -> Column:
        if c == FLAG:
            return F.lit(True)
        if c in cols or c in hidden:
            whole = F.coalesce(F.sum(c), F.lit(0).cast(df.schema[c].dataType))
            return whole if na_rm else F.when(F.count(c) == F.count(F.lit(1)), whole)
        if c == first:
            return F.lit(row_name)
        return F.lit(fill) if fill is not None else F.lit(None).cast(df.schema[c].dataType)

    bottom = (df.filter(~F.col(FLAG)) if knows else df).agg(*[total(c).alias(c) for c in df.columns])
    texts = [c for c in df.columns if c not in cols and c not in hidden and (c == first or fill is not None)]
    out = df.withColumns({c: F.col(c).cast("string") for c in texts}).unionByName(bottom)
    return out.withMetadata(FLAG, {"total_columns": marked}) if knows else out


def adorn_percentages(
    df: DataFrame, denominator: str = "row", na_rm: bool = True, cols: Sequence[str] | None = None
) -> DataFrame:
    """Shares along rows, columns or the whole frame.

    On a remembered frame totals rows and columns get their shares but are no part of the base; on any other frame call
    it before adding totals.
    """
    cols = _chosen(df, cols)
    inner = [c for c in cols if c not in _total_columns(df)]
    cells = df.filter(~F.col(FLAG)) if FLAG in df.columns else df

    def across(parts: list[Column]) -> Column:
        parts = [F.coalesce(p, F.lit(0)) for p in parts] if na_rm else parts
        return sum(parts[1:], parts[0])

    if denominator == "row":
        base = across([F.col(c) for c in inner])
        return df.withColumns({c: F.try_divide(F.col(c), base) for c in cols})

    def down(c: str) -> Column:
        return F.sum(c) if na_rm else F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))

    if denominator == "col":
        sums = cells.agg(*[down(c).alias(c) for c in cols])
        return df.withColumns({c: F.try_divide(F.col(c), sums.select(c).scalar()) for c in cols})
    if denominator == "all":
        whole = cells.agg(across([down(c) for c in inner]).alias("t")).scalar()
        return df.withColumns({c: F.try_divide(F.col(c), whole) for c in cols})
    raise ValueError("denominator must be row, col or all")


def adorn_rounding(
    df: DataFrame, digits: int = 1, rounding: str = "half even", cols: Sequence[str] | None = None
) -> DataFrame:
    return df.withColumns({c: rounder(rounding)(c, digits) for c in _chosen(df, cols)})


def adorn_pct_formatting(
    df: DataFrame, digits: int = 1, rounding: str = "half even", affix: bool = True, cols: Sequence[str] | None = None
) -> DataFrame:
    return df.withColumns({c: format_share(c, digits, rounding, affix) for c in _chosen(df, cols)})


def adorn_ns(
    df: DataFrame,
    ns: DataFrame | None = None,
    position: str = "rear",
    format_func: Callable[[Column], Column] = format_count,
    cols: Sequence[str] | None = None,
) -> DataFrame:
    """Append counts to cells: those a remembered frame began with, or those of ``ns`` (same first column, same column names).

    Rows of ``ns`` are matched by the first column, never by position; remembered counts stand in the row itself, totals included.
    """
    key = df.columns[0]
    if ns is None:
        if FLAG not in df.columns:
            raise ValueError("give the counts, or let the frame remember them")
        cols = list(cols) if cols else [c for c in df.columns if c != key and CORE + c in df.columns]
        joined = df.withColumns({f"__n_{c}": F.col(f"`{CORE}{c}`") for c in cols})
    else:
        cols = list(cols) if cols else [c for c in df.columns if c != key and c in ns.columns and c not in _hidden(df)]
        counts = ns.select(F.col(key).cast(df.schema[key].dataType).alias(key), *[F.col(c).alias(f"__n_{c}") for c in cols])
        joined = join_null_safe(df, counts, [key], "left")

    def cell(c: str) -> Column:
        shown, count = F.col(c).cast("string"), F.concat(F.lit("("), format_func(F.col(f"__n_{c}")), F.lit(")"))
        if position == "rear":
            return F.concat(shown, F.lit(" "), count)
        return F.concat(format_func(F.col(f"__n_{c}")), F.lit(" ("), shown, F.lit(")"))

    return joined.withColumns({c: cell(c) for c in cols}).select(*df.columns)


def adorn_title(df: DataFrame, row_name: str | None = None, col_name: str = "") -> DataFrame:
    """Both variable names in the first column's name."""
    return df.withColumnRenamed(df.columns[0], f"{row_name or df.columns[0]}/{col_name}")
