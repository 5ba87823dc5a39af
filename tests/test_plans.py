"""Work-time pipelines on literal entries, with the cases the sample feeds lack."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from worktally.plans import charges as ch
from worktally.plans import monthly as mo
from worktally.plans import week_table as ts
from worktally.plans import weekly as wk

M = dt.date(2024, 5, 20)  # a Monday
RAW = "period date, date date, project string, subproject string, code string, hours double, length double"


def day(n):
    return M + dt.timedelta(n)


def entries(spark, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], RAW)


def simple(spark, *rows):
    """(week, day, project, code, hours[, length]) counted from the first Monday."""
    full = [(day(7 * r[0]), day(r[1]), r[2], None, r[3], r[4], r[5] if len(r) > 5 else 8.0) for r in rows]
    return entries(spark, *full)


def test_entry_moves_into_its_week_and_fiscal_year(spark, rows):
    raw = entries(
        spark,
        (day(7), day(3), "a", None, "c", 1.0, 8.0),
        (day(14), day(14), "a", None, "c", 1.0, 8.0),
        (None, day(1), "a", None, "c", 1.0, 8.0),
        (day(0), None, "a", None, "c", 1.0, 8.0),
        (day(0), day(1), "a", None, "c", None, 8.0),
        (day(0), day(1), "a", None, "c", float("nan"), 8.0),
    )
    typed = ch.type_charges(raw)
    assert rows(typed, "year", "month", "date") == [
        (2023, dt.date(2024, 5, 1), day(7)), (2024, dt.date(2024, 6, 1), day(14)), (None, None, None),
    ]
    assert ch.type_charges(raw, need_hours=False).count() == 5


def test_gate_rejects_what_cannot_be_filled(spark, rows):
    raw = simple(spark, (0, 0, "a", None, 1.0), (0, 1, "a", "c1", 1.0), (0, 2, "a", None, 1.0), (0, 2, None, "c2", 1.0))
    good, bad = ch.prepare_charges(raw)
    assert rows(good, "date", "project", "code") == [(day(1), "a", "c1"), (day(2), "a", "c1")]
    assert rows(bad, "date", "project", "code") == [(day(0), "a", None), (day(2), None, "c2")]
    ledger = ch.charge_ledger(raw)
    assert rows(ledger, "date", "code", "hours", "n") == [(day(1), "c1", 1.0, 1), (day(2), "c1", 1.0, 1)]


def test_weekly_targets(spark):
    raw = simple(spark, (0, 0, "a", "c", 30.0, 7.0), (1, 7, "a", "c", 40.0, 8.0), (1, 8, "a", "c", 5.0, 6.0), (2, 14, "a", "c", 10.0, 8.0))
    charges = ch.type_charges(raw)

    def balances(target):
        return [r["balance"] for r in wk.weekly_balance(charges, target).orderBy("period").collect()]

    assert balances("constant") == [30.0, 75.0 - 36, 85.0 - 72]
    assert balances("current") == [30.0, 75.0 - 35, 85.0 - 80]
    assert balances("cumulative") == [30.0 - 35, 75.0 - 70, None]
    assert balances("lagged") == [30.0, 75.0 - 35, 85.0 - 70]
    with pytest.raises(ValueError):
        wk.weekly_balance(charges, "other")


def test_missing_hours_and_lengths_blank_what_follows(spark):
    raw = simple(spark, (0, 0, "a", "c", 1.0), (1, 7, "a", "c", None), (1, 8, "a", "c", 2.0), (2, 14, "a", "c", 1.0))
    weeks = wk.weekly_balance(ch.type_charges(raw, need_hours=False), "current").orderBy("period").collect()
    assert [(r["weekhours"], r["cumhours"], r["balance"]) for r in weeks] == [(1.0, 1.0, 1.0), (None, None, None), (1.0, None, None)]
    raw = simple(spark, (0, 0, "a", "c", 1.0), (1, 7, "a", "c", 2.0, None), (2, 14, "a", "c", 1.0), (3, 21, "a", "c", 1.0))
    weeks = wk.weekly_balance(ch.type_charges(raw)).orderBy("period").collect()
    assert [(r["weektarget"], r["balance"]) for r in weeks] == [(40.0, -39.0), (None, None), (40.0, None), (40.0, None)]


def test_week_without_period_comes_last(spark):
    raw = entries(spark, (day(0), day(0), "a", None, "c", 1.0, 8.0), (None, day(3), "a", None, "c", 2.0, 8.0))
    weeks = wk.weekly_balance(ch.type_charges(raw)).collect()
    assert {r["period"]: (r["cumhours"], r["balance"]) for r in weeks} == {day(0): (1.0, -39.0), None: (3.0, None)}


@pytest.fixture
def mixed(spark):
    """Two people, projects that start and stop, a week over a month end."""
    out = []
    for i in range(140):
        project = ["Admin", "Alpha x", "Beta y", "Leave", "Alpha z"][i * 7 % 5]
        out.append((i // 7, i, project, f"C{i * 3 % 4}" if i % 3 else None, (i * 5 % 9 - 1) / 4, [7.5, 8.0, None][i % 3]))
    return simple(spark, *out).withColumn("person", F.datediff("date", F.lit(M)) % 2)


def test_ledger_and_entries_agree(spark, rows, mixed):
    fine, ledger = ch.prepare_charges(mixed)[0], ch.charge_ledger(mixed)
    for by in ([], ["person"]):
        fine, ledger = ch.prepare_charges(mixed, by)[0], ch.charge_ledger(mixed, by)
        assert rows(wk.weekly_balance(fine, by=by)) == rows(wk.weekly_balance(ledger, by=by))
        assert rows(ts.week_table(fine, str(M), by)) == rows(ts.week_table(ledger, str(M), by))
        assert rows(mo.monthly(ch.combine(fine, by), by)) == rows(mo.monthly(ch.combine(ledger, by), by))


def test_combine_equals_the_plain_validity_join(spark, rows, mixed):
    from worktally.operators.joins import union_feeds, validity_join

    for by in ([], ["person"]):
        charges = ch.charge_ledger(mixed, by)
        projects = ch.derive_projects(charges, by)
        everything = union_feeds(charges, ch.blank_weeks(charges, projects, by))
        plain = validity_join(everything, projects, [*by, "year", "project", "code"]).drop("startdate", "enddate")
        combined = ch.combine(charges, by)
        assert rows(combined.select(*sorted(combined.columns))) == rows(plain.select(*sorted(plain.columns)))
        assert combined.filter("length IS NULL AND hours = 0").count() > 0


def test_combine_and_months_of_missing_people_and_weeks(spark, rows, mixed):
    from worktally.operators.joins import union_feeds, validity_join

    person = F.when(F.col("person") == 0, F.col("person"))
    raw = mixed.withColumn("person", person).withColumn("period", F.when(F.dayofmonth("date") % 9 != 4, F.col("period")))
    charges = ch.type_charges(raw, ["person"], need_hours=False)
    charges = union_feeds(charges, charges.limit(30).withColumn("period", F.lit(None).cast("date")))
    projects = ch.derive_projects(charges, ["person"])
    everything = union_feeds(ch.with_counts(charges), ch.blank_weeks(charges, projects, ["person"]))
    plain = validity_join(everything, projects, ["person", "year", "project", "code"]).drop("startdate", "enddate")
    combined = ch.combine(charges, ["person"])
    assert rows(combined.select(*sorted(combined.columns))) == rows(plain.select(*sorted(plain.columns)))
    assert rows(ch.combine(ch.collapse(charges), ["person"]).drop("hours", "n", "missing").distinct()) == rows(
        combined.drop("hours", "n", "missing").select(*ch.collapse(charges).drop("hours", "n", "missing").columns).distinct()
    )
    # Each person's months are what that person alone would have.
    together = mo.monthly(combined, ["person"])
    for one in (F.col("person").isNull(), F.col("person") == 0):
        alone = mo.monthly(ch.combine(charges.filter(one).drop("person")))
        assert rows(together.filter(one).drop("person")) == rows(alone) != []


def test_what_is_sent_for_codes_and_weeks(spark, mixed, monkeypatch):
    """Entries with a code were sent to the filling join, and a range as one row for each of its weeks."""
    from worktally.operators import fill

    joined, sent = fill.join_null_safe, []
    monkeypatch.setattr(fill, "join_null_safe", lambda left, *args: sent.append(left.count()) or joined(left, *args))
    typed = ch.type_charges(mixed, ["person"])
    fill.fill_down(typed, "code", ["person", "project"]).count()
    assert sent == [typed.filter("code IS NULL").count()] and 0 < sent[0] < typed.count()
    for charges in (typed, ch.collapse(typed)):
        assert "sequence(" not in ch.combine(charges, ["person"])._jdf.queryExecution().optimizedPlan().toString()


def test_blank_weeks_do_not_change_the_week_table(spark, rows, mixed):
    charges = ch.charge_ledger(mixed)
    done = str(day(28))
    with_blanks, without = ts.week_table(ch.combine(charges), done), ts.week_table(charges, done)
    assert rows(with_blanks) == rows(without)
    total = without.agg(F.sum("Total")).first()[0]
    cells = charges.filter(F.col("period") > done).groupBy("period", "date", "project", "code").agg(F.sum("hours").alias("h"))
    assert total == cells.filter("h > 0").agg(F.sum("h")).first()[0]


def test_week_table_cells_and_totals(spark, rows):
    raw = simple(
        spark,
        (0, 0, "a", "c", 9.0),
        (1, 7, "a", "c", 2.0),
        (1, 7, "a", "c", 1.0),
        (1, 8, "a", "c", -1.0),
        (1, 13, "Admin", "d", 4.0),
        (1, 9, "b", "e", 0.0),
    )
    got = ts.week_table(ch.type_charges(raw), str(M))
    assert rows(got) == [
        (day(7), "Admin", "d", None, None, None, None, None, None, 4.0, 4.0, 3.0, 7.0),
        (day(7), "a", "c", 3.0, None, None, None, None, None, None, 3.0, 3.0, 7.0),
    ]
    assert rows(ts.printable(got), "Mon", "Total") == [(" - ", "4.0"), ("3.0", "3.0")]


PLAN = "year int, project string, subproject string, startdate date, enddate date, code string, subcode string, budgeted double, profile double"


def plan(spark, *rows):
    return ch.prepare_projects(spark.createDataFrame([tuple(r) for r in rows], PLAN))


def test_prepared_plan(spark, rows):
    typed = plan(spark, (2023, "a", None, M, None, "c", None, 1.0, 119.0), (2023, "b", None, M, day(30), "c", "s", None, 119.0))
    assert rows(typed, "project", "enddate", "subcode") == [("a", day(30), ""), ("b", day(30), "s")]
    raw = spark.createDataFrame([(None, "a", None, M, M, "c", None, 1.0, 1.0)], PLAN)
    assert rows(ch.prepare_projects(raw, 2021), "year") == [(2021,)]


def test_missing_subproject_matches_the_plan(spark, rows):
    raw = simple(spark, (0, 0, "a", None, 2.0), (0, 1, "zz", None, 4.0))
    planned = plan(spark, (2023, "a", None, M, day(30), "c", "s", 1.0, 119.0))
    combined = ch.combine_with_plan(ch.plan_ledger(raw), planned)
    assert rows(combined, "project", "date", "hours", "code") == [("a", day(0), 0.0, "c"), ("a", day(0), 2.0, "c")]


def test_several_plan_rows_weigh_the_median(spark):
    """Two plan rows of one key meet every row; the median is over all of them."""
    raw = simple(spark, (0, 0, "a", None, 2.0), (0, 1, "a", None, 2.0))
    planned = plan(
        spark,
        (2023, "a", "s", M, day(30), "c", "1", 10.0, 119.0),
        (2023, "a", "s", M, day(0), "d", "1", 30.0, 119.0),
    )
    raw = raw.withColumn("subproject", F.lit("s"))
    lines = mo.monthly_budget(ch.combine_with_plan(ch.plan_ledger(raw), planned)).collect()
    # Rows with budget 10: both entries and two blanks; with 30: the first entry and two blanks.
    assert [(r["project2"], r["budgeted"], r["hours"], r["code2"]) for r in lines] == [("a s", 10.0, 6.0, "d 1")]


def test_budget_scaling(spark):
    raw = simple(spark, (0, 0, "Alpha", None, 2.0), (0, 1, "Beta", None, 2.0), (0, 2, "Leave", None, 4.0)).withColumn("subproject", F.lit("s"))
    planned = plan(
        spark,
        (2023, "Alpha", "s", M, day(6), "c", None, 119.0, 0.0),
        (2023, "Beta", "s", M, day(6), "c", None, 357.0, 0.0),
        (2023, "Leave", "s", M, day(6), "c", None, 1000.0, 0.0),
    )
    combined = ch.combine_with_plan(ch.plan_ledger(raw), planned)
    kept = {r["project2"]: (r["budgeted"], r["budgeted2"], r["profile"]) for r in mo.monthly_budget(combined).collect()}
    assert kept == {"Alpha s": (119.0, 29.8, 119.0), "Beta s": (357.0, 89.2, 119.0), "NPT": (55.0, 13.8, 119.0)}
    dropped = {r["project2"]: r["budgeted2"] for r in mo.monthly_budget(combined, keep_npt=False).collect()}
    assert dropped == {"Alpha s": 29.8, "Beta s": 89.2}


def test_budget_without_length_or_sum(spark):
    raw = simple(spark, (0, 0, "Alpha", None, 2.0, None)).withColumn("subproject", F.lit("s"))
    planned = plan(spark, (2023, "Alpha", "s", M, day(6), "c", None, 50.0, 0.0))
    line = mo.monthly_budget(ch.combine_with_plan(ch.plan_ledger(raw), planned)).first()
    assert (line["length"], line["profile"], line["budgeted"], line["budgeted2"]) == (None, None, 50.0, 0.0)
    none = plan(spark, (2023, "Alpha", "s", M, day(6), "c", None, None, 0.0))
    raw = raw.withColumn("length", F.lit(8.0))
    line = mo.monthly_budget(ch.combine_with_plan(ch.plan_ledger(raw), none)).first()
    assert (line["profile"], line["budgeted"], line["budgeted2"]) == (119.0, 0.0, 0.0)


def test_monthly_gaps_and_codes(spark, rows):
    raw = simple(spark, (0, 0, "Alpha", "c1", 2.0), (0, 1, "Alpha", "c2", -3.0), (2, 14, "Leave", "c", 4.0), (2, 15, "Admin", "c", 1.0))
    lines = mo.monthly(ch.combine(ch.type_charges(raw)))
    assert rows(lines, "year", "month", "project2", "code2", "hours", "profile", "project") == [
        (2023, dt.date(2024, 5, 1), "Alpha", "c2", 0.0, 119.0, "Alpha"),
        (2023, dt.date(2024, 5, 1), "NPT", "0", 0.0, 119.0, "NPT"),
        (2024, dt.date(2024, 6, 1), "Alpha", "0", 0.0, 119.0, "Alpha"),
        (2024, dt.date(2024, 6, 1), "NPT", "NPT", 5.0, 119.0, "NPT"),
    ]


def test_yearly_rounds_in_sequence(spark, rows):
    lines = spark.createDataFrame(
        [(2023, dt.date(2024, 4, 1), "a", 2.4), (2023, dt.date(2024, 5, 1), "a", 2.4), (2023, dt.date(2024, 5, 1), "b", 0.0)],
        "year int, month date, project string, hours double",
    )
    # 4.8 becomes 5, and half of 5 rounds to the even 2; half of 4.8 would be 2 as well, of 6.9 / 2 not.
    assert rows(mo.yearly_totals(lines), "year", "project", "months", "hours", "hours_month") == [(2023, "a", 2, 5.0, 2.0)]
    more = lines.withColumn("hours", F.col("hours") * 2.9 / 2)
    assert rows(mo.yearly_totals(more), "hours", "hours_month") == [(7.0, 4.0)]


def test_flat_budget(spark):
    raw = simple(spark, (0, 0, "a", None, 2.0), (2, 14, "a", None, 1.0), (0, 1, "free", None, 3.0))
    planned = spark.createDataFrame(
        [
            (2023, "a", "s", M, M, "c", None, 10.0, 0.0),
            (2023, "a", "t", M, M, "c", None, 30.0, 0.0),
            (2023, "idle", "s", M, M, "c", None, None, 0.0),
            (2023, "later", "s", M, M, "c", None, 10.0, 0.0),
            (2023, "Leave", "s", M, M, "c", None, 7.0, 0.0),
        ],
        PLAN,
    )
    got = mo.monthly_budget_flat(ch.plan_ledger(raw), planned, moved=None).collect()
    table = {(r["project"], r["month"].month): (round(r["monthbudget"], 6), r["monthhours"], r["keep"], r["level"]) for r in got}
    unit = 101 / 50
    assert table == {
        ("a", 5): (round(20 * unit, 6), 4.0, True, 1), ("a", 6): (round(20 * unit, 6), 2.0, True, 1),
        ("free", 5): (0.0, 3.0, True, 3), ("free", 6): (0.0, 0.0, True, 3),
        ("Leave", 5): (0.0, 0.0, False, 2), ("Leave", 6): (0.0, 0.0, False, 2),
        ("idle", 5): (0.0, 0.0, False, 4), ("idle", 6): (0.0, 0.0, False, 4),
        ("later", 5): (0.0, 0.0, False, 5), ("later", 6): (0.0, 0.0, False, 5),
    }


def test_chart_frames(spark, rows):
    weeks = wk.weekly_balance(ch.type_charges(simple(spark, (0, 0, "a", "c", 2.0))))
    assert rows(mo.chart_data(weeks, "weekly")) == [(M, "balance", None), (M, "weekhours", 2.0)]
    with pytest.raises(ValueError):
        mo.chart_data(weeks, "pie")


def test_daily(spark, rows):
    raw = simple(spark, (0, 0, "a", None, 2.0), (0, 0, "a", None, 1.0), (0, 1, "b", None, None)).withColumn("subproject", F.lit("s"))
    planned = plan(spark, (2023, "a", "s", M, day(6), "c", "1", 1.0, 0.0))
    got = ts.daily(ch.plan_ledger(raw, need_hours=False), planned)
    assert rows(got, "date", "project", "code", "dayhours", "wday") == [(M, "a", "c", 3.0, "Mon"), (day(1), "b", None, None, "Tue")]
