"""Missing-value rules, rounding, dates and names on literal rows."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from worktally.functions import aggregates as agg
from worktally.functions import dates, names, scalars

D = dt.date


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_missing_value_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0, True), (None, 2.0, None), (3.0, None, False)], "a double, b double, c boolean")
    got = df.select(
        scalars.later_of("a", "b"),
        scalars.if_else(F.col("c"), F.lit("y"), F.lit("n")),
        scalars.in_set("a", [1.0, 3.0]),
        scalars.zero_to_null(F.col("a") - 1),
        scalars.null_to_zero("a"),
        scalars.clamp_zero(F.col("a") - 2),
        scalars.clamp_zero(F.col("a") - 2, keep_missing=True),
        scalars.paste("a", F.lit("x")),
        scalars.pad_cell("a"),
    ).collect()
    assert [tuple(r) for r in got] == [
        (2.0, "y", True, None, 1.0, 0.0, 0.0, "1.0 x", "1.0"),
        (None, None, False, None, 0.0, 0.0, None, "NA x", " - "),
        (None, "n", True, 2.0, 3.0, 1.0, 1.0, "3.0 x", "3.0"),
    ]


def test_null_if_keeps_missing(spark):
    df = spark.createDataFrame([("NA",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(scalars.null_if("s", ["NA", ""])).collect()] == [None, "x", None]


def test_strict_and_lenient_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", None), ("c", None)], "k string, x double")
    got = df.groupBy("k").agg(
        agg.sum_strict("x"), agg.sum_lenient("x"), agg.median_strict("x"), agg.median_lenient("x"), agg.mean_lenient("x"), agg.n_distinct("x")
    )
    assert sorted(tuple(r) for r in got.collect()) == [
        ("a", 3.0, 3.0, 1.5, 1.5, 1.5, 2),
        ("b", None, 4.0, None, 4.0, 4.0, 2),
        ("c", None, 0.0, None, None, None, 1),
    ]


def test_weighted_median_equals_median_of_repeated_rows(spark):
    counted = spark.createDataFrame([(7.5, 3), (8.0, 2), (4.0, 4)], "x double, n bigint")
    repeated = counted.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    assert counted.select(agg.median_weighted("x", "n")).first()[0] == repeated.select(F.median("x")).first()[0]


def test_rounding(spark):
    assert one(
        spark,
        scalars.round_half_even(F.lit(10.5)),
        scalars.round_half_up(F.lit(10.5)),
        scalars.round_half_even(F.lit(2.5)),
        scalars.round_half_even(F.lit(3.5)),
        scalars.round_half_up(F.lit(2.5)),
        scalars.round_half_up(F.lit(3.5)),
        scalars.round_half_up(F.lit(-2.5)),
        scalars.round_to_fraction(F.lit(0.2), 4),
        scalars.round_to_fraction(F.lit(0.25000000001), 4),
        scalars.round_to_fraction(F.lit(0.3), 3, 2),
        scalars.signif_half_up(F.lit(0.0), 3),
        scalars.signif_half_up(F.lit(-12345.0), 3),
        scalars.signif_half_up(F.lit(0.012345), 2),
        scalars.signif_half_up(F.lit(12.5), 2),
    ) == (10.0, 11.0, 2.0, 4.0, 3.0, 4.0, -3.0, 0.25, 0.25, 0.33, 0.0, -12300.0, 0.012, 13.0)


def test_number_texts(spark):
    assert one(
        spark,
        scalars.format_count(F.lit(1234)),
        scalars.format_count(F.lit(12)),
        scalars.format_share(F.lit(0.1234), 2),
        scalars.format_share(F.lit(0.125), 0, "half up"),
        scalars.format_share(F.lit(0.5), 1, affix=False),
        scalars.format_share(F.lit(None).cast("double")),
        scalars.first_letters(F.lit("12 ab34cd")),
        scalars.first_letters(F.lit("12")),
    ) == ("1,234", "12", "12.34%", "13%", "50.0", "-", "ab", None)


def test_fiscal_year_and_month(spark):
    days = spark.sql("SELECT explode(sequence(date'1999-01-01', date'2005-12-31', interval 1 day)) AS d")
    wrong = days.filter(
        scalars.fiscal_year("d") != F.when(F.month("d") >= 6, F.year("d")).otherwise(F.year("d") - 1)
    )
    assert wrong.count() == 0
    assert one(spark, scalars.remap_month(F.lit("2022-02-17").cast("date"), "2022-02-01", "2022-03-01"))[0] == D(2022, 3, 1)


def test_spreadsheet_dates(spark):
    values = [42001.1, 42001.0, 33.0, 60.0, 61.0, 59.0, None, 41103.01, 42223.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, n double").orderBy("i")
    assert [r[0] for r in df.select(dates.excel_date("n")).collect()] == [
        D(2014, 12, 28), D(2014, 12, 28), D(1900, 2, 2), None, D(1900, 3, 1), D(1900, 2, 28), None, D(2012, 7, 13), D(2015, 8, 7),
    ]
    assert one(spark, dates.excel_date(F.lit(41103.01), "mac pre-2011")) == (D(2016, 7, 14),)
    assert one(spark, dates.excel_date(F.lit(43001.01), include_time=True).cast("string")) == ("2017-09-23 00:14:24",)
    in_zone = dates.excel_date(F.lit(43001.5), include_time=True, tz="America/New_York").cast("string")
    assert one(spark, in_zone) == ("2017-09-23 16:00:00",)
    # 2017-03-12 02:30 does not exist in New York.
    skipped = dates.excel_date(F.lit(42806 + 2.5 / 24), include_time=True, tz="America/New_York")
    assert one(spark, skipped) == (None,)


def test_mixed_dates(spark):
    texts = ["2020-02-29", "40000.1", "2020-02-29 13:45:00", "2020/03/01", "no date", None, " 40000 "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = df.select(dates.to_date_mixed("t"), dates.to_timestamp_mixed("t").cast("string")).collect()
    assert [tuple(r) for r in got] == [
        (D(2020, 2, 29), "2020-02-29 00:00:00"),
        (D(2009, 7, 6), "2009-07-06 02:24:00"),
        (D(2020, 2, 29), "2020-02-29 13:45:00"),
        (D(2020, 3, 1), "2020-03-01 00:00:00"),
        (None, None),
        (None, None),
        (D(2009, 7, 6), "2009-07-06 00:00:00"),
    ]


def test_statistics_package_dates(spark):
    got = one(
        spark,
        dates.sas_date(F.lit(21639)),
        dates.sas_timestamp(F.lit(21639 * 86400 + 6 * 3600)).cast("string"),
        dates.sas_time(F.lit(3661)),
    )
    assert got == (D(2019, 3, 31), "2019-03-31 06:00:00", dt.timedelta(seconds=3661))


@pytest.mark.parametrize(
    "dirty, clean",
    [
        ("firstName", "first_name"),
        ("variableName", "variable_name"),
        ("ábc@!*", "abc"),
        ("% successful (2009)", "percent_successful_2009"),
        ("REPEAT VALUE", "repeat_value"),
        ("çãüœ", "cauoe"),
        ("%", "percent"),
        ("#", "number"),
        ("œ", "oe"),
        ("δ", "d"),
        ("", "x"),
        ("2009 total", "x2009_total"),
        ("HTMLParser", "html_parser"),
        ("abc123", "abc123"),
        ("abc 123", "abc_123"),
        ("don't", "dont"),
    ],
)
def test_name_rule(spark, dirty, clean):
    assert names.clean_name_list([dirty]) == [clean]
    assert one(spark, names.clean_text(F.lit(dirty))) == (clean,)


def test_repeated_names_and_cases(spark):
    assert names.clean_name_list(["REPEAT VALUE", "REPEAT VALUE", "", "repeat_value_2"]) == [
        "repeat_value", "repeat_value_3", "x", "repeat_value_2",
    ]
    assert names.clean_name_list(["a", "a"], allow_dupes=True) == ["a", "a"]
    word = ["first nameOf"]
    styles = {c: names.clean_name_list(word, c)[0] for c in names.CASES}
    assert styles == {
        "snake": "first_name_of", "screaming_snake": "FIRST_NAME_OF", "small_camel": "firstNameOf", "big_camel": "FirstNameOf",
        "lower": "firstnameof", "upper": "FIRSTNAMEOF", "title": "First Name Of", "sentence": "First name of", "none": "first_name_Of",
    }
    assert names.clean_name_list(["a&b"], replace={"&": " and "}) == ["a_and_b"]
    df = spark.createDataFrame([(1, 2)], ["firstName", "First Name"])
    assert names.clean_names(df).columns == ["first_name", "first_name_2"]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=12), min_size=1, max_size=40))
def test_column_and_value_rules_agree(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(names.clean_text("t")).collect()]
    assert got == names.clean_name_list(texts, allow_dupes=True)


def test_numbered_values(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["A b", "a_b", "c", "a b"])], "i int, t string")
    got = names.normalize_values(df, "t", "clean", order=["i"]).orderBy("i").select("clean").collect()
    assert [r[0] for r in got] == ["a_b", "a_b_2", "c", "a_b_3"]
