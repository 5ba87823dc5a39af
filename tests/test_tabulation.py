"""Frequency tables, adornments and independence tests."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from worktally.operators import adorn, stats, tabulate

LIKERT = ["strongly agree", "agree", "neutral", "disagree", "strongly disagree"]


@pytest.fixture
def pairs(spark):
    data = [("x", "b"), ("x", "a"), ("x", "a"), ("y", "a"), ("y", None), (None, "a"), ("y", "")]
    return spark.createDataFrame(data, "r string, c string")


def test_one_way_with_missing(spark, rows):
    df = spark.createDataFrame([(v,) for v in ["big", "big", "small", "small", "small", None]], "v string")
    assert rows(tabulate.tabyl_one(df, "v")) == [
        ("big", 2, 2 / 6, 0.4), ("small", 3, 0.5, 0.6), (None, 1, 1 / 6, None),
    ]
    assert rows(tabulate.tabyl_one(df, "v", show_na=False)) == [("big", 2, 0.4, 0.4), ("small", 3, 0.6, 0.6)]
    listed = tabulate.tabyl_one(df, "v", levels=["big", "medium", "small"])
    assert ("medium", 0, 0.0, 0.0) in rows(listed)
    assert len(rows(tabulate.tabyl_one(df, "v", levels=["big", "medium"], show_missing_levels=False))) == 3


def test_one_way_of_a_column_named_n(spark, rows):
    df = spark.createDataFrame([("a",), ("a",)], "k string")
    again = tabulate.tabyl_one(df, "k").select("k", "percent")
    assert rows(tabulate.tabyl_one(again, "percent"))[0][:2] == (1.0, 1)


def test_two_way_wide(pairs, rows):
    wide = tabulate.tabyl(pairs, "r", "c").wide()
    assert wide.columns == ["r", "emptystring_", "a", "b", "NA_"]
    assert rows(wide) == [("NA", 0.0, 1.0, 0.0, 0.0), ("x", 0.0, 2.0, 1.0, 0.0), ("y", 1.0, 1.0, 0.0, 1.0)]


def test_totals_are_told_from_missing(pairs, rows):
    tab = tabulate.tabyl(pairs, "r", "c").adorn_totals(name=("All", "Sum"))
    cells = {(r, c, rt, ct): n for r, c, rt, ct, n in rows(tab.cells, "r", "c", "row_total", "col_total", "n")}
    assert cells[(None, None, True, True)] == 7
    assert cells[(None, "a", False, False)] == 1 and cells[(None, "a", True, False)] == 4
    assert cells[("y", None, False, False)] == 1 and cells[("y", None, False, True)] == 3
    assert cells[(None, None, False, True)] == 1 and cells[(None, None, True, False)] == 1
    wide = tab.wide()
    assert wide.columns[-1] == "Sum" and ("All", 1.0, 4.0, 1.0, 1.0, 7.0) in rows(wide)


@pytest.mark.parametrize("denominator", ["row", "col", "all"])
def test_shares_sum_to_one(pairs, denominator):
    tab = tabulate.tabyl(pairs, "r", "c").adorn_totals().adorn_percentages(denominator)
    keys = {"row": ["r", "row_total"], "col": ["c", "col_total"], "all": []}[denominator]
    inner = tab.cells
    if denominator != "col":
        inner = inner.filter("NOT col_total")
    if denominator != "row":
        inner = inner.filter("NOT row_total")
    sums = inner.groupBy(*keys).agg(F.sum("value")).collect()
    assert all(r[-1] == pytest.approx(1.0) for r in sums)


def test_text_cells(pairs, rows):
    tab = tabulate.tabyl(pairs, "r", "c").adorn_totals("col").adorn_percentages("row")
    text = tab.adorn_pct_formatting(1, "half up").adorn_ns().adorn_title("combined", "Row", "Col").wide(levels=["a", "b"])
    assert text.columns == ["Row/Col", "a", "b", "emptystring_", "NA_", "Total"]
    assert ("x", "66.7% (2)", "33.3% (1)", "100.0% (3)") in rows(text, "Row/Col", "a", "b", "Total")
    front = tab.adorn_pct_formatting(0, affix=False).adorn_ns("front").wide(levels=["a"])
    assert ("x", "2 (67)", "3 (100)") in rows(front, "r", "a", "Total")
    ns = pairs.select("r", "c").distinct().withColumn("n", F.lit(1234))
    assert ("x", "66.7% (1,234)") in rows(tabulate.tabyl(pairs, "r", "c").adorn_percentages().adorn_pct_formatting().adorn_ns(ns=ns).wide(["a"]), "r", "a")


def test_three_way_keeps_the_split_a_key(spark, rows):
    df = spark.createDataFrame([("s", "x", "a"), ("t", "x", "a"), ("t", "x", "b")], "g string, r string, c string")
    tab = tabulate.tabyl(df, "r", "c", "g").adorn_totals("row").adorn_percentages("all")
    assert rows(tab.wide(["a", "b"])) == [("s", "Total", 1.0, 0.0), ("s", "x", 1.0, 0.0), ("t", "Total", 0.5, 0.5), ("t", "x", 0.5, 0.5)]
    levelled = tabulate.tabyl(df, "r", "c", "g", row_levels=["x", "y"], col_levels=["a", "b"])
    assert len(rows(levelled.counts())) == 8


def test_frame_totals(spark, rows):
    cases = spark.createDataFrame([("East", 2015, 125.0, 13.0), ("West", 2015, 87.0, 12.0)], "region string, year int, recovered double, died double")
    got = adorn.adorn_totals(cases, ["col", "row"], name="Total Cases", cols=["recovered", "died"])
    assert rows(got) == [
        ("East", "2015", 125.0, 13.0, 138.0), ("Total Cases", "-", 212.0, 25.0, 237.0), ("West", "2015", 87.0, 12.0, 99.0),
    ]
    typed = adorn.adorn_totals(cases, "row", fill=None, cols=["died"])
    assert dict(typed.dtypes)["year"] == "int" and ("Total", None, None, 25.0) in rows(typed)


def test_frame_totals_missing(spark, rows):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 5)], "k string, x bigint, y bigint")
    assert rows(adorn.adorn_totals(df, ["row", "col"])) == [("Total", 3, 5, 8), ("a", 1, None, 1), ("b", 2, 5, 7)]
    assert rows(adorn.adorn_totals(df, "row", na_rm=False)) == [("Total", 3, None), ("a", 1, None), ("b", 2, 5)]


def test_frame_shares_and_text(spark, rows):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("b", 3.0, 1.0)], "k string, x double, y double")
    assert rows(adorn.adorn_percentages(df)) == [("a", 0.25, 0.75), ("b", 0.75, 0.25)]
    assert rows(adorn.adorn_percentages(df, "all", cols=["x"])) == [("a", 0.25, 3.0), ("b", 0.75, 1.0)]
    assert rows(adorn.adorn_pct_formatting(adorn.adorn_percentages(df, "col"), 0)) == [("a", "25%", "75%"), ("b", "75%", "25%")]
    assert rows(adorn.adorn_rounding(spark.createDataFrame([("a", 0.125)], "k string, x double"), 2)) == [("a", 0.12)]
    ns = spark.createDataFrame([("b", 2000, 1), ("a", 10, 20)], "k string, x bigint, y bigint")
    titled = adorn.adorn_title(adorn.adorn_ns(df, ns), "Key", "Var")
    assert titled.columns[0] == "Key/Var" and rows(titled) == [("a", "1.0 (10)", "3.0 (20)"), ("b", "3.0 (2,000)", "1.0 (1)")]


def test_top_levels(spark, rows):
    answers = ["strongly agree", "agree", "neutral", "neutral", "disagree", "strongly agree", None]
    df = spark.createDataFrame([(a,) for a in answers], "f string")
    got = [tuple(r) for r in tabulate.top_levels(df, "f", LIKERT).collect()]
    assert got == [
        ("head", "strongly agree, agree", 3, 0.5),
        ("middle", "neutral", 2, 2 / 6),
        ("tail", "disagree, strongly disagree", 1, 1 / 6),
    ]
    one = [(r["place"], r["n"]) for r in tabulate.top_levels(df, "f", LIKERT, n=1).collect()]
    assert one == [("head", 2), ("middle", 4), ("tail", 0)]
    shown = tabulate.top_levels(df, "f", LIKERT, show_na=True, sort=True).collect()
    assert [(r["place"], r["n"]) for r in shown] == [("head", 3), ("middle", 2), ("tail", 1), ("missing", 1)]
    with pytest.raises(ValueError):
        tabulate.top_levels(df, "f", LIKERT, n=3)


def test_top_levels_counts_unlisted_values_as_missing(spark):
    df = spark.createDataFrame([(a,) for a in ["agree", "neutral", "no answer", "no answer", None]], "f string")
    shown = [tuple(r) for r in tabulate.top_levels(df, "f", LIKERT, show_na=True).select("place", "n", "percent").collect()]
    assert shown == [("head", 1, 0.2), ("middle", 1, 0.2), ("tail", 0, 0.0), ("missing", 3, 0.6)]
    hidden = [(r["place"], r["n"]) for r in tabulate.top_levels(df, "f", LIKERT).collect()]
    assert hidden == [("head", 1), ("middle", 1), ("tail", 0)]


def test_chisq_against_the_full_grid(spark):
    table = {("x", "a"): 10, ("x", "b"): 20, ("y", "a"): 30, ("z", "b"): 15, ("z", "a"): 5}
    df = spark.createDataFrame([k for k, n in table.items() for _ in range(n)], "r string, c string")
    got = stats.chisq_test(df, "r", "c").first()
    total = sum(table.values())
    sums = [{}, {}]
    for k, n in table.items():
        for axis in (0, 1):
            sums[axis][k[axis]] = sums[axis].get(k[axis], 0) + n
    want = sum(
        (table.get((r, c), 0) - sums[0][r] * sums[1][c] / total) ** 2 / (sums[0][r] * sums[1][c] / total) for r in sums[0] for c in sums[1]
    )
    assert got["statistic"] == pytest.approx(want) and (got["dof"], got["n"]) == (2, 80)
    assert got["p_value"] == pytest.approx(math.exp(-want / 2))
    with pytest.warns(UserWarning, match="totals"):
        totalled = stats.chisq_stat(tabulate.tabyl(df, "r", "c").adorn_totals()).first()
    assert totalled["statistic"] == pytest.approx(want)


def test_chisq_correction(spark):
    df = spark.createDataFrame([(0, 0)] * 12 + [(0, 1)] * 5 + [(1, 0)] * 3 + [(1, 1)] * 9, "a int, b int")
    n, det = 29, 12 * 9 - 5 * 3
    margins = 17 * 12 * 15 * 14
    got = stats.chisq_test(df, "a", "b").first()
    assert got["statistic"] == pytest.approx(n * (abs(det) - n / 2) ** 2 / margins)
    assert got["p_value"] == pytest.approx(math.erfc(math.sqrt(got["statistic"] / 2)))
    assert stats.chisq_test(df, "a", "b", correct=False).first()["statistic"] == pytest.approx(n * det**2 / margins)


def brute_fisher(a, b, c, d):
    row, col, total = a + b, a + c, a + b + c + d
    weight = {
        k: math.comb(row, k) * math.comb(total - row, col - k) for k in range(max(0, row + col - total), min(row, col) + 1)
    }
    limit = weight[a] * (1 + 1e-7)
    return sum(w for w in weight.values() if w <= limit) / sum(weight.values())


@settings(max_examples=300, deadline=None)
@given(*[st.integers(0, 60)] * 4)
def test_fisher_helper_against_all_tables(a, b, c, d):
    assert stats._fisher_two_sided(a, b, c, d) == pytest.approx(brute_fisher(a, b, c, d), rel=1e-9, abs=1e-300)


def test_fisher_on_large_counts():
    assert stats._fisher_two_sided(5_000_000, 5_000_000, 5_000_000, 5_000_000) == pytest.approx(1.0)
    # The normal limit of the test, with its continuity correction.
    a, b, c, d = 5_003_000, 4_997_000, 4_997_000, 5_003_000
    z = (abs(a * d - b * c) / (a + b + c + d) - 0.5) / math.sqrt((a + b) * (c + d) * (a + c) * (b + d) / (a + b + c + d) ** 3)
    assert stats._fisher_two_sided(a, b, c, d) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_fisher_by_group(spark):
    data = [("g", 1, 1)] * 8 + [("g", 1, 0)] * 2 + [("g", 0, 1)] + [("g", 0, 0)] * 5 + [("h", 1, 1), ("h", 0, None)]
    df = spark.createDataFrame(data, "g string, a int, b int")
    got = {r["g"]: r for r in stats.fisher_test_2x2(df, ["g"], "a", "b").collect()}
    assert got["g"]["p_value"] == pytest.approx(brute_fisher(8, 2, 1, 5))
    assert (got["h"]["n11"], got["h"]["n00"], got["h"]["p_value"]) == (1, 0, 1.0)
