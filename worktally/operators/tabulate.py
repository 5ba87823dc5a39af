"""Frequency tables of one, two or three variables and their adornments.

Counts stay in long form, one row per combination that occurs, so a variable
with many values costs rows, not columns. One grouped count reads the data;
shares, totals and text work on the counts. ``wide`` renders the usual table
at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktally.functions.names import unique_names
from worktally.functions.scalars import format_count, format_share, rounder
from worktally.operators.category import EMPTY_LABEL, MISSING_LABEL, Category, label  # noqa: F401
from worktally.operators.joins import attach_group, join_null_safe

# Fixed value: label of totals in tables.
TOTAL_LABEL = "Total"

#: Names of the variables inside; outside they have their own, whatever those are.
SPLIT, ROW, COL = "__split", "__row", "__col"


def level_table(df: DataFrame, col: str, levels: Sequence) -> DataFrame:
    """(level, ord) rows of an ordered category; as short as its level list."""
    kind = df.schema[col].dataType.simpleString()
    rows = [(level, i) for i, level in enumerate(levels)]
    return df.sparkSession.createDataFrame(rows, f"`{col}` {kind}, __ord int")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def tabyl_one(
    df: DataFrame,
    col: str,
    levels: Sequence | None = None,
    show_na: bool = True,
    show_missing_levels: bool = True,
) -> DataFrame:
    """Count, percent and valid percent (missing left out) per value.

    With ``levels``, absent levels show with count 0 unless switched off. Rows come in the order of the levels, other
    values next, missing last. A variable of any name can be counted; the name of a figure that it takes gets a number (``n_2``).
    """
    counts = df.groupBy(quoted(col).alias(ROW)).agg(F.count(F.lit(1)).alias("n"))
    if not show_na:
        counts = counts.filter(F.col(ROW).isNotNull())
    if levels is not None and show_missing_levels:
        counts = join_null_safe(counts, level_table(counts, ROW, levels).select(ROW), [ROW], "full")
        counts = counts.withColumn("n", F.coalesce("n", F.lit(0)))
    present = F.when(F.col(ROW).isNotNull(), F.col("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    valid = counts.agg(F.sum(present).alias("t")).scalar()
    shares = {"n": F.col("n"), "percent": F.try_divide(F.col("n"), total), "valid_percent": F.try_divide(present, valid)}
    names = unique_names([col, *shares])
    counts = counts.orderBy(*Category(counts.schema[ROW].dataType, tuple(levels or ())).order(F.col(ROW)))
    return counts.select(F.col(ROW).alias(col), *[c.alias(name) for name, c in zip(names[1:], shares.values())])


@dataclass(frozen=True)
class Tabulation:
    """Long counts of a two-way table, optionally split by a third variable.

    ``held`` has the variables' columns under hidden names, ``row_total`` and ``col_total`` flags
    (a total is told from a missing value by flag, not by label), the count
    ``n``, the current number ``value`` and, once formatted, ``text``; ``cells`` shows it with the variables' own names.
    """

    held: DataFrame
    row: str
    col: str
    split: str | None = None
    row_levels: tuple | None = None
    col_levels: tuple | None = None
    corner: str | None = None
    totals: tuple = ()
    row_total_name: str = TOTAL_LABEL
    col_total_name: str = TOTAL_LABEL

    @property
    def _by(self) -> list[str]:
        return [SPLIT] if self.split else []

    @property
    def variables(self) -> dict[str, str]:
        """Hidden name to own name."""
        return ({SPLIT: self.split} if self.split else {}) | {ROW: self.row, COL: self.col}

    @property
    def row_key(self) -> list[str]:
        return [*self._by, ROW, "row_total"]

    @property
    def col_key(self) -> list[str]:
        return [*self._by, COL, "col_total"]

    def category(self, hidden: str) -> Category:
        levels = {ROW: self.row_levels, COL: self.col_levels}.get(hidden) or ()
        return Category(self.held.schema[hidden].dataType, tuple(levels))

    def _own_names(self, df: DataFrame) -> DataFrame:
        """Variables under their own names; a figure whose name they take gets a number."""
        figures = [c for c in df.columns if c not in self.variables]
        own = [self.variables[c] for c in df.columns if c in self.variables]
        names = dict(zip(figures, unique_names([*own, *figures])[len(own) :]))
        return df.toDF(*[self.variables.get(c) or names[c] for c in df.columns])

    @property
    def cells(self) -> DataFrame:
        return self._own_names(self.held)

    def counts(self) -> DataFrame:
        """Plain (variables, n) rows without totals, in the order of the levels."""
        plain = self.held.filter(~F.col("row_total") & ~F.col("col_total")).select(*self.variables, "n")
        return self._own_names(plain.orderBy(*[k for c in self.variables for k in self.category(c).order(F.col(c))]))

    def adorn_totals(self, where: Sequence[str] | str = ("row", "col"), name: str | Sequence[str] = TOTAL_LABEL) -> Tabulation:
        """Add a totals row, column or both; two names allowed (row, column)."""
        where = (where,) if isinstance(where, str) else tuple(where)
        row_name, col_name = (name, name) if isinstance(name, str) else name
        base = self.held.filter(~F.col("row_total") & ~F.col("col_total"))
        keep = [F.col(c) for c in self._by]
        sums = [F.sum("n").alias("n"), F.sum("value").alias("value")]
        # grouping() marks totals, so a missing value stays a value.
        marks = [F.grouping(ROW).alias("__r"), F.grouping(COL).alias("__c")]
        sets = [[*keep, F.col(ROW), F.col(COL)]]
        if "row" in where:
            sets.append([*keep, F.col(COL)])
        if "col" in where:
            sets.append([*keep, F.col(ROW)])
        if "row" in where and "col" in where:
            sets.append(keep)
        grouped = base.groupingSets(sets, *keep, F.col(ROW), F.col(COL)).agg(*marks, *sums)
        cells = grouped.select(
            *self._by,
            ROW,
            COL,
            (F.col("__r") == 1).alias("row_total"),
            (F.col("__c") == 1).alias("col_total"),
            "n",
            "value",
        )
        return replace(self, held=cells, totals=where, row_total_name=row_name, col_total_name=col_name)

    def adorn_percentages(self, denominator: str = "row") -> Tabulation:
        """Turn counts into shares of their row, column or whole table.

        Totals take part as numerators only.
        """
        if denominator == "row":
            keys, counted = self.row_key, ~F.col("col_total")
        elif denominator == "col":
            keys, counted = self.col_key, ~F.col("row_total")
        elif denominator == "all":
            keys, counted = self._by, ~F.col("row_total") & ~F.col("col_total")
        else:
            raise ValueError("denominator must be row, col or all")
        cells = attach_group(self.held, keys, __base=F.sum(F.when(counted, F.col("value"))))
        return replace(self, held=cells.withColumn("value", F.try_divide("value", "__base")).drop("__base"))

    def adorn_rounding(self, digits: int = 1, rounding: str = "half even") -> Tabulation:
        return replace(self, held=self.held.withColumn("value", rounder(rounding)("value", digits)))

    def adorn_pct_formatting(self, digits: int = 1, rounding: str = "half even", affix: bool = True) -> Tabulation:
        return replace(self, held=self.held.withColumn("text", format_share("value", digits, rounding, affix)))

    def adorn_ns(
        self,
        position: str = "rear",
        ns: DataFrame | None = None,
        format_func: Callable[[Column], Column] = format_count,
    ) -> Tabulation:
        """Append the counts to each cell, or put them in front.

        Counts travel with their cell, so re-sorting cannot misplace them.
        ``ns`` supplies other numbers, matched by key, in a column ``n`` (``n_2`` and so on where a variable has that name).
        """
        cells = self.held
        if ns is not None:
            given = ns.select(*[quoted(own).alias(hidden) for hidden, own in self.variables.items()], self._count_of(ns).alias("n"))
            cells = join_null_safe(cells.drop("n"), given, list(self.variables), "left")
        text = F.col("text") if "text" in cells.columns else F.col("value").cast("string")
        count = format_func(F.col("n"))
        if position == "rear":
            text = F.concat(text, F.lit(" ("), count, F.lit(")"))
        elif position == "front":
            text = F.concat(count, F.lit(" ("), text, F.lit(")"))
        else:
            raise ValueError("position must be rear or front")
        return replace(self, held=cells.withColumn("text", text))

    def adorn_title(self, placement: str = "combined", row_name: str | None = None, col_name: str | None = None) -> Tabulation:
        """Name the first column of the wide table after both variables."""
        if placement != "combined":
            raise ValueError("only the combined placement has a place in a typed table")
        return replace(self, corner=f"{row_name or self.row}/{col_name or self.col}")

    def _count_of(self, ns: DataFrame) -> Column:
        return quoted(unique_names([*self.variables.values(), "n"])[-1])

    def wide(self, levels: Sequence | None = None, absent=None) -> DataFrame:
        """One column per level of the second variable, missing last.

        ``levels`` come first, listed or not, then the levels of the category, then all other values found in the counts, at
        most as many as Spark allows a pivot. Columns are told apart by value: a value that reads like the
        label of missing values or of totals keeps its name, and that label gets a number. A row is a value of the first variable,
        so the text ``NA`` and a missing value stay apart. Rows are in the order of the levels, other values in their own order, missing
        next, the totals row last.
        """
        cells, by = self.held, self._by
        shown = "text" if "text" in cells.columns else "value"
        most = int(cells.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        value, total = F.col(COL), F.col("col_total")
        # Totals of the rows have no value of the second variable of their own.
        axis = self.category(COL).axis(cells, value, total, levels or (), self.col_total_name, most)
        table = cells.withColumn("__code", Category.code(value, total))
        table = table.groupBy(*by, ROW, "row_total").pivot("__code", [code for code, _ in axis]).agg(F.first(shown))
        row = F.when(F.col("row_total"), F.lit(self.row_total_name)).otherwise(label(F.col(ROW), "NA"))
        fill = 0.0 if shown == "value" and absent is None else absent
        kept = [quoted(code) if fill is None else F.coalesce(quoted(code), F.lit(fill)) for code, _ in axis]
        # The first columns keep their names; a column whose name they take gets a number.
        heads = [*([self.split] if self.split else []), self.corner or self.row]
        names = unique_names([*heads, *[name for _, name in axis]])[len(heads) :]
        table = table.orderBy(*by, "row_total", *self.category(ROW).order(F.col(ROW)))
        first = [F.col(c).alias(self.split) for c in by]
        return table.select(*first, row.alias(heads[-1]), *[c.alias(name) for c, name in zip(kept, names)])


def tabyl(
    df: DataFrame,
    row: str,
    col: str,
    split: str | None = None,
    show_na: bool = True,
    row_levels: Sequence | None = None,
    col_levels: Sequence | None = None,
    show_missing_levels: bool = True,
) -> Tabulation:
    """Count each pair of values, optionally within a third variable.

    Level lists add their absent combinations with count 0; empty values of the
    third variable never appear.
    """
    own = ({SPLIT: split} if split else {}) | {ROW: row, COL: col}
    counts = df.groupBy(*[quoted(name).alias(hidden) for hidden, name in own.items()]).agg(F.count(F.lit(1)).alias("n"))
    if not show_na:
        counts = counts.na.drop(subset=list(own))
    if show_missing_levels and (row_levels or col_levels):
        counts = _with_levels(counts, list(own), ROW, COL, row_levels, col_levels)
    cells = counts.withColumns(
        {
            "row_total": F.lit(False),
            "col_total": F.lit(False),
            "value": F.col("n").cast("double"),
        }
    )
    return Tabulation(
        cells, row, col, split, tuple(row_levels) if row_levels else None, tuple(col_levels) if col_levels else None
    )


def _with_levels(counts, keys, row, col, row_levels, col_levels) -> DataFrame:
    """Add absent pairs: literal level lists are exploded next to the known keys."""
    by = keys[:-2]

    def members(c: str, levels: Sequence | None) -> DataFrame:
        known = counts.select(*by, c).distinct()
        if levels is None:
            return known
        kind = counts.schema[c].dataType
        listed = F.array(*[F.lit(v).cast(kind) for v in levels])
        groups = counts.select(*by).distinct() if by else counts.sparkSession.range(1).drop("id")
        return known.unionByName(groups.withColumn(c, F.explode(listed))).distinct()

    # The side with a literal level list is the short one, it becomes the array.
    long, short = (row, col) if col_levels else (col, row)
    long_levels, short_levels = (row_levels, col_levels) if col_levels else (col_levels, row_levels)
    listed = members(short, short_levels)
    axis = listed.groupBy(*by).agg(F.collect_list(F.struct(short)).alias("__axis"))
    grid = members(long, long_levels)
    grid = join_null_safe(grid, axis, by) if by else grid.withColumn("__axis", axis.scalar())
    grid = grid.withColumn("__axis", F.explode("__axis")).select(*by, long, F.col(f"__axis.{short}").alias(short))
    out = join_null_safe(grid, counts, keys, "left").select(*keys, "n")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def top_levels(
    df: DataFrame, col: str, levels: Sequence[str], n: int = 2, show_na: bool = False, sort: bool = False
) -> DataFrame:
    """Counts of an ordered category in its first n, middle and last n levels; a value that is no level counts as missing."""
    if 2 * n > len(levels):
        raise ValueError("head and tail overlap: n is more than half the number of levels")
    cut = [("head", levels[:n]), ("middle", levels[n : len(levels) - n]), ("tail", levels[len(levels) - n :])]
    cut = [(place, members) for place, members in cut if members]
    counts = df.groupBy(quoted(col).alias(ROW)).agg(F.count(F.lit(1)).alias("n"))
    wanted = F.col(ROW).isin(list(levels))
    if not show_na:
        counts = counts.filter(wanted)
    place = F.lit("missing")
    for name, members in cut:
        place = F.when(F.col(ROW).isin(list(members)), F.lit(name)).otherwise(place)
    names = [(name, ", ".join(members), i) for i, (name, members) in enumerate(cut)]
    if show_na:
        names.append(("missing", "NA", len(names)))
    groups = df.sparkSession.createDataFrame(names, "place string, levels string, ord int")
    sums = counts.groupBy(place.alias("place")).agg(F.sum("n").alias("n"))
    # A placed group always shows; the missing line only when there is one.
    table = groups.join(sums, "place", "left").filter(F.col("n").isNotNull() | (F.col("place") != "missing"))
    table = table.withColumn("n", F.coalesce("n", F.lit(0)))
    table = attach_group(table, [], __total=F.sum("n"))
    table = table.withColumn("percent", F.try_divide("n", "__total"))
    table = table.orderBy(F.desc("n"), "ord") if sort else table.orderBy("ord")
    return table.select("place", "levels", "n", "percent")
