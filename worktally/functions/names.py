"""One naming rule for columns and for text values.

Column names are cleaned in Python, since a schema is a short list the driver
already holds. Text columns go through the same steps as a Spark expression.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktally.functions.scalars import as_col

# Symbols spelled out as words.
SYMBOL_WORDS = {"%": " percent ", "#": " number "}

# Quotes vanish instead of separating words.
QUOTES = "'\"‘’“”`´"

# Letters that have no accent to strip and need a spelling.
SPELLED_LETTERS = {
    "œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ß": "ss", "þ": "th", "Þ": "TH",
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L",
    "ħ": "h", "Ħ": "H", "ı": "i", "ŋ": "n", "Ŋ": "N", "ŧ": "t", "Ŧ": "T",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th",
    "ι": "i", "κ": "k", "λ": "l", "μ": "u", "µ": "u", "ν": "n", "ξ": "x", "ο": "o",
    "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "ch",
    "ψ": "ps", "ω": "o", "Δ": "D", "Γ": "G", "Θ": "TH", "Λ": "L", "Ξ": "X", "Π": "P",
    "Σ": "S", "Φ": "PH", "Ψ": "PS", "Ω": "O",
}


def _strip_table() -> dict[str, str]:
    """Accented letters to their base letter, derived from Unicode decomposition."""
    table = {}
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        base = unicodedata.normalize("NFKD", ch)[0]
        if ch not in SPELLED_LETTERS and base != ch and base.isascii() and base.isalpha():
            table[ch] = base
    return table


STRIPPED_LETTERS = _strip_table()

CASES = ("snake", "screaming_snake", "small_camel", "big_camel", "lower", "upper", "title", "sentence", "none")


def _words(name: str, replace: Mapping[str, str]) -> list[str]:
    for old, new in replace.items():
        name = name.replace(old, new)
    for old, new in SYMBOL_WORDS.items():
        name = name.replace(old, new)
    name = "".join(SPELLED_LETTERS.get(ch, STRIPPED_LETTERS.get(ch, ch)) for ch in name if ch not in QUOTES)
    name = re.sub(r"[^A-Za-z0-9]+", " ", name)
    name = re.sub(r"([a-z])([A-Z])", r"\1 \2", name)
    name = re.sub(r"([A-Z])([A-Z][a-z])", r"\1 \2", name)
    return name.split()


def _styled(words: list[str], case: str) -> str:
    if case == "snake":
        return "_".join(w.lower() for w in words)
    if case == "screaming_snake":
        return "_".join(w.upper() for w in words)
    if case == "small_camel":
        return "".join(w.lower() if i == 0 else w.capitalize() for i, w in enumerate(words))
    if case == "big_camel":
        return "".join(w.capitalize() for w in words)
    if case == "lower":
        return "".join(w.lower() for w in words)
    if case == "upper":
        return "".join(w.upper() for w in words)
    if case == "title":
        return " ".join(w.capitalize() for w in words)
    if case == "sentence":
        return " ".join(w.capitalize() if i == 0 else w.lower() for i, w in enumerate(words))
    if case == "none":
        return "_".join(words)
    raise ValueError(f"case must be one of {CASES}, not {case!r}")


def clean_name_list(
    names: Iterable[str | None],
    case: str = "snake",
    replace: Mapping[str, str] | None = None,
    allow_dupes: bool = False,
) -> list[str]:
    """Cleaned names in input order; a repeat gets ``_2``, ``_3`` and so on."""
    cleaned = []
    for name in names:
        text = _styled(_words(name or "", replace or {}), case) or "x"
        cleaned.append(f"x{text}" if text[0].isdigit() else text)
    return cleaned if allow_dupes else unique_names(cleaned)


def unique_names(names: list[str]) -> list[str]:
    """Repeated names numbered ``_2``, ``_3``, skipping numbers that are taken."""
    taken, out = set(names), []
    used: dict[str, int] = {}
    for text in names:
        used[text] = used.get(text, 0) + 1
        unique = text
        if used[text] > 1:
            unique = f"{text}_{used[text]}"
            while unique in taken:
                used[text] += 1
                unique = f"{text}_{used[text]}"
            taken.add(unique)
        out.append(unique)
    return out


def clean_names(df: DataFrame, case: str = "snake", replace: Mapping[str, str] | None = None, allow_dupes: bool = False) -> DataFrame:
    """Rename every column by the naming rule; a projection only, no job.

    With ``allow_dupes`` names that become equal stay so.
    """
    return df.toDF(*clean_name_list(df.columns, case, replace, allow_dupes))


def clean_text(c: Column | str, replace: Mapping[str, str] | None = None) -> Column:
    """The snake-case naming rule as a column expression; missing reads as empty."""
    text = F.coalesce(as_col(c).cast("string"), F.lit(""))
    # The caller's words first: they win over the built-in ones.
    for old, new in [*(replace or {}).items(), *SYMBOL_WORDS.items()]:
        text = F.replace(text, F.lit(old), F.lit(new))
    spelled = {k: v for k, v in SPELLED_LETTERS.items() if len(v) > 1}
    single = {**STRIPPED_LETTERS, **{k: v for k, v in SPELLED_LETTERS.items() if len(v) == 1}}
    for old, new in spelled.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    # translate() drops the characters that have no counterpart: the quotes.
    text = F.translate(text, "".join(single) + QUOTES, "".join(single.values()))
    text = F.regexp_replace(text, "[^A-Za-z0-9]+", " ")
    text = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    text = F.regexp_replace(text, "([A-Z])([A-Z][a-z])", "$1 $2")
    text = F.regexp_replace(F.lower(F.trim(text)), " +", "_")
    text = F.when(text == "", F.lit("x")).otherwise(text)
    return F.when(text.rlike("^[0-9]"), F.concat(F.lit("x"), text)).otherwise(text)


def normalize_values(
    df: DataFrame,
    col: str,
    into: str | None = None,
    order: Iterable[str] | None = None,
    replace: Mapping[str, str] | None = None,
) -> DataFrame:
    """Clean a text column by the naming rule.

    Without ``order`` repeats stay as they are and the result is one projection.
    With ``order`` every result is unique: the first of equal values keeps its text, the others get the numbers from 2 on, in that
    order, leaving out those that would make a value that is there already (``a``, ``a``, ``a_2`` become ``a``, ``a_3``, ``a_2``).
    One very frequent value is spread over many tasks.
    """
    into = into or col
    out = df.withColumn(into, clean_text(col, replace))
    if order is None:
        return out
    from worktally.operators.ranking import numbered
    from worktally.session import stored

    seq = stored(numbered(out, by=[into], order=list(order), into="__seq"), "named")
    number = _free_numbers(seq.select(F.col(into).alias("__base"), "__seq"))
    if number is not None:
        seq = seq.join(number.withColumnRenamed("__seq", "__at"), (F.col(into) == F.col("__base")) & (F.col("__seq") == F.col("__at")), "left")
        seq = seq.withColumn("__seq", F.coalesce("__number", "__seq"))
    suffixed = F.when(F.col("__seq") > 1, F.concat(F.col(into), F.lit("_"), F.col("__seq").cast("string")))
    return seq.withColumn(into, F.coalesce(suffixed, F.col(into))).select(*out.columns)


#: A value that is another one and a number, as numbering writes it: from 2 on, without leading zeros.
NUMBERED = r"(?s)^(.*)_([2-9]|[1-9][0-9]{1,17})$"


def _free_numbers(seq: DataFrame) -> DataFrame | None:
    """(__base, __seq, __number) of repeated values some of whose numbers are taken; nothing if none is.

    The m-th repeat gets the m-th number that is free. The i-th taken number k has k - 1 - i free ones below it, so the m-th free number is m + 1 and the
    number of taken ones with k - 1 - i < m: a running count over repeats and taken numbers in one order.
    """
    from worktally.operators.ranking import numbered, running_sum

    values = seq.filter(F.col("__seq") == 1).select(F.col("__base").alias("value"))
    taken = values.select(F.regexp_extract("value", NUMBERED, 1).alias("__of"), F.regexp_extract("value", NUMBERED, 2).try_cast("bigint").alias("k"))
    repeated = seq.filter(F.col("__seq") == 2).select("__base")
    taken = taken.filter("k is not null").join(repeated, F.col("__of") == F.col("__base")).select("__base", "k")
    if not taken.limit(1).count():
        return None
    edges = numbered(taken, ["__base"], ["k"], "i").select("__base", (F.col("k") - 1 - F.col("i")).alias("m"), F.lit(0).alias("late"), F.lit(1).alias("one"), F.lit(None).cast("bigint").alias("__seq"))
    asked = seq.join(taken.select(F.col("__base").alias("__of")).distinct(), F.col("__base") == F.col("__of"), "left_semi").filter(F.col("__seq") > 1)
    # An edge counts for all larger m: those that ask for m come before the edges at m.
    asked = asked.select("__base", (F.col("__seq") - 1).alias("m"), F.lit(-1).alias("late"), F.lit(0).alias("one"), "__seq")
    counted = running_sum(edges.unionByName(asked), ["__base"], ["m", "late"], "one", "shift")
    return counted.filter("late = -1").select("__base", "__seq", (F.col("m") + 1 + F.col("shift")).alias("__number"))
