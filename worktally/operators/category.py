"""Ordered categories: a list of levels and the rank that each value of a column has among them.

Counting, totals and pivots work on values and ranks, never on printed labels, so that a value that reads like a label (``NA_``,
``Total``, an empty text) stays what it is. Listed levels come first in their order, then all other values in theirs,
then what is missing, then totals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktally.functions.names import unique_names

# Labels of missing values and empty text in the columns of tables.
MISSING_LABEL = "NA_"
EMPTY_LABEL = "emptystring_"


@dataclass(frozen=True)
class Category:
    """The domain of one variable: its type and, if it is ordered, its levels."""

    kind: T.DataType
    levels: tuple = ()

    @property
    def listed(self) -> list:
        """Levels without the missing one, each once."""
        return list(dict.fromkeys(v for v in self.levels if v is not None))

    def rank(self, value: Column) -> Column:
        """Place among the levels, from 0; one place for all other values and one for missing ones."""
        listed = self.listed
        found = F.array_position(F.array(*[F.lit(v).cast(self.kind) for v in listed]), value) if listed else F.lit(0)
        return F.when(value.isNull(), len(listed) + 1).when(found > 0, (found - 1).cast("int")).otherwise(len(listed))

    def order(self, value: Column) -> list[Column]:
        """Sort keys of a column of the category."""
        return [self.rank(value), value.asc_nulls_last()] if self.listed else [value.asc_nulls_last()]

    @staticmethod
    def code(value: Column, total: Column) -> Column:
        """Text that tells values, missing values and totals apart; no two values share one."""
        return F.when(total, F.lit("t")).when(value.isNull(), F.lit("m")).otherwise(F.concat(F.lit("v"), value.cast("string")))

    def axis(self, cells: DataFrame, value: Column, total: Column, extra: Sequence, total_name: str, most: int) -> list[tuple[str, str]]:
        """(code, name) of the columns that a pivot makes of the category: levels, other values, missing, total; names are unique.

        ``extra`` are values that get a column whether they occur or not, before all others. More than ``most`` values are an error.
        """
        def text(values: Sequence) -> list[str]:
            if not values:
                return []
            row = cells.sparkSession.range(1).select(*[F.lit(v).cast(self.kind).cast("string").alias(f"v{i}") for i, v in enumerate(values)])
            return list(row.first())

        first = [v for v in (*extra, *self.levels)]
        codes = ["v" + t if t is not None else "m" for t in text(first)]
        found = cells.select(value.alias("value"), total.alias("total")).distinct()
        if found.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} values, keep the table in long form")
        seen = found.orderBy("total", *self.order(F.col("value"))).select(self.code(F.col("value"), F.col("total")), "total").collect()
        late = {"m", "t"} - set(codes)
        codes += [c for c, _ in seen if c not in late] + [c for c in ("m", "t") if c in late and any(c == s for s, _ in seen)]
        codes = list(dict.fromkeys(codes))
        names = [total_name if c == "t" else MISSING_LABEL if c == "m" else c[1:] or EMPTY_LABEL for c in codes]
        return list(zip(codes, unique_names(names)))


def label(c: Column, missing: str = MISSING_LABEL) -> Column:
    """Cell of a variable as printable text."""
    text = c.cast("string")
    return F.when(text == "", F.lit(EMPTY_LABEL)).otherwise(F.coalesce(text, F.lit(missing)))
