"""SQL counterparts of the registered queries, in DuckDB's dialect.

They state each result the direct way (row-level windows, full joins, no
pre-aggregation), so that they check the reduced forms the library runs.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

NPT = "('ECONOMY', 'LARGE', 'PROMO')"
DONE = "DATE '2001-06-04'"
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

RAW = """
charges_raw AS (
  SELECT l_suppkey AS person, date,
    CASE WHEN l_linenumber = 7 THEN monday + 7 ELSE monday END AS period,
    p_type AS project, p_brand AS subproject,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE concat('C', CAST(p_size AS VARCHAR)) END AS code,
    CASE WHEN l_linenumber = 5 AND l_quantity = 50 THEN NULL ELSE l_quantity / 4 END AS hours,
    CASE WHEN year(date) < 1998 THEN 7.5::DOUBLE ELSE 8.0::DOUBLE END AS length
  FROM (SELECT l.*, p.p_type, p.p_brand, p.p_size, CAST(l_shipdate AS DATE) AS date,
          CAST(date_trunc('week', l_shipdate) AS DATE) AS monday
        FROM lineitem l JOIN part p ON l_partkey = p_partkey)
)"""


def _typed(need_hours: bool) -> str:
    return f"""
typed AS (
  SELECT person, CASE WHEN month(date) >= 6 THEN year(date) ELSE year(date) - 1 END AS year,
    CAST(date_trunc('month', date) AS DATE) AS month, period, date, project, subproject, code, hours, length
  FROM (SELECT * REPLACE (CASE WHEN period IS NOT NULL THEN greatest(date, period) END AS date)
        FROM charges_raw WHERE date IS NOT NULL {'AND hours IS NOT NULL' if need_hours else ''})
)"""


TYPED = RAW + "," + _typed(True)
TYPED_ALL = RAW + "," + _typed(False)


def charges(by: str = "") -> str:
    part = f"{by}, project" if by else "project"
    return TYPED + f""",
filled AS (
  SELECT * REPLACE (last_value(code IGNORE NULLS) OVER (
    PARTITION BY {part} ORDER BY date, code NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS code)
  FROM typed
),
charges AS (SELECT * FROM filled WHERE project IS NOT NULL AND code IS NOT NULL)"""


def combined(by: str = "") -> str:
    p = f"{by}, " if by else ""
    same = f"AND b.{by} = p.{by}" if by else ""
    same_c = f"AND c.{by} = p.{by}" if by else ""
    pp = f"p.{by}, " if by else ""
    return charges(by) + f""",
projects AS (SELECT {p}year, project, code, min(date) AS startdate, max(date) AS enddate FROM charges GROUP BY ALL),
blanks AS (
  SELECT {pp}b.year, b.month, b.period, b.period AS date, p.project, p.code, 0.0::DOUBLE AS hours, NULL::DOUBLE AS length
  FROM (SELECT DISTINCT {p}year, month, period FROM charges) b LEFT JOIN projects p ON b.year = p.year {same}
),
combined AS (
  SELECT c.* FROM (
    SELECT {p}year, month, period, date, project, code, hours, length FROM charges
    UNION ALL BY NAME SELECT * FROM blanks) c
  LEFT JOIN projects p ON c.year = p.year AND c.project = p.project AND c.code = p.code {same_c}
  WHERE c.date >= p.startdate AND c.date <= p.enddate
)"""


PLAN = """
plan_days AS (SELECT * REPLACE (greatest(date, period) AS date) FROM charges_raw WHERE hours IS NOT NULL),
plan_raw AS (
  SELECT year, project, subproject, startdate,
    CASE WHEN subproject = 'Brand#1' THEN NULL ELSE lastdate END AS enddate, code,
    CASE WHEN subproject = 'Brand#2' THEN NULL ELSE 'S1' END AS subcode,
    CASE WHEN subproject = 'Brand#3' THEN NULL ELSE n / 4.0::DOUBLE END AS budgeted, 119.0::DOUBLE AS profile
  FROM (SELECT CASE WHEN month(date) >= 6 THEN year(date) ELSE year(date) - 1 END AS year, project, subproject,
          min(date) AS startdate, max(date) AS lastdate, max(code) AS code, count(*) AS n
        FROM plan_days GROUP BY ALL)
)"""

PLAN_TYPED = PLAN + """,
plan AS (
  SELECT year, project, subproject, startdate,
    coalesce(enddate, (SELECT max(enddate) FROM plan_raw)) AS enddate,
    code, coalesce(subcode, '') AS subcode, budgeted, profile
  FROM plan_raw
)"""


def plan_combined(need_hours: bool) -> str:
    return (TYPED if need_hours else TYPED_ALL) + "," + PLAN_TYPED + """,
blanks AS (
  SELECT w.year, w.month, w.period, w.period AS date, p.project, p.subproject, 0.0::DOUBLE AS hours, NULL::DOUBLE AS length
  FROM (SELECT DISTINCT year, month, period FROM typed) w LEFT JOIN plan p ON w.year = p.year
),
combined AS (
  SELECT c.*, p.startdate, p.enddate, p.code, p.subcode, p.budgeted, p.profile
  FROM (SELECT year, month, period, date, project, subproject, hours, length FROM typed
        UNION ALL BY NAME SELECT * FROM blanks) c
  LEFT JOIN plan p ON c.year IS NOT DISTINCT FROM p.year AND c.project IS NOT DISTINCT FROM p.project
    AND c.subproject IS NOT DISTINCT FROM p.subproject
  WHERE c.date >= p.startdate AND c.date <= p.enddate
)"""


def sql(name: str, ctes: str, body: str) -> None:
    ORACLES[name] = f"WITH {ctes.strip()}\n{body.strip()}" if ctes else body.strip()


TEXT_WEEK = "CAST(period AS VARCHAR) AS period"
ROW_TEXT = "year, CAST(month AS VARCHAR) AS month, CAST(period AS VARCHAR) AS period, CAST(date AS VARCHAR) AS date"

# ------------------------------------------------------- charges and projects
sql("prepare_charges", charges("person"), f"SELECT person, {ROW_TEXT}, project, code, hours, length FROM charges")
sql("fill_down_code", charges(), "SELECT CAST(date AS VARCHAR) AS date, project, code, hours FROM filled")
sql(
    "quality_rejects",
    charges("person"),
    f"SELECT person, {ROW_TEXT}, project, code, hours, length FROM filled WHERE project IS NULL OR code IS NULL",
)
sql("freshness", TYPED, "SELECT CAST(max(date) AS VARCHAR) AS latest FROM typed")
sql(
    "charge_ledger",
    charges(),
    f"""SELECT {ROW_TEXT}, project, code, length, sum(hours) AS hours, count(*) AS n, CAST(0 AS BIGINT) AS missing
FROM charges GROUP BY year, month, period, date, project, code, length""",
)
sql("snapshot_charges", TYPED, f"SELECT person, {ROW_TEXT}, project, code, hours, length FROM typed")
RANGE_TEXT = "CAST(startdate AS VARCHAR) AS startdate, CAST(enddate AS VARCHAR) AS enddate"
sql("derive_projects", combined(), f"SELECT year, project, code, {RANGE_TEXT} FROM projects")
sql(
    "prepare_projects",
    RAW + "," + PLAN_TYPED,
    f"SELECT year, project, subproject, {RANGE_TEXT}, code, subcode, budgeted, profile FROM plan",
)
sql("blank_weeks", combined(), f"SELECT {ROW_TEXT}, project, code, hours, length FROM blanks")
sql("combine_validity_join", combined(), f"SELECT {ROW_TEXT}, project, code, hours, length FROM combined")
sql(
    "combine_with_plan",
    plan_combined(True),
    f"""SELECT {ROW_TEXT}, project, subproject, length, sum(hours) AS hours, count(*) AS n, CAST(0 AS BIGINT) AS missing,
  {RANGE_TEXT}, code, subcode, budgeted, profile
FROM combined
GROUP BY year, month, period, date, project, subproject, length, startdate, enddate, code, subcode, budgeted, profile""",
)
sql(
    "full_outer_plan",
    TYPED + "," + PLAN,
    """SELECT coalesce(h.year, p.year) AS year, coalesce(h.project, p.project) AS project, h.hours, p.subcode, p.budgeted
FROM (SELECT year, project, sum(hours) AS hours FROM typed GROUP BY ALL) h
FULL JOIN (SELECT year + 1 AS year, project, subcode, budgeted FROM plan_raw) p
  ON h.year = p.year AND h.project = p.project""",
)
sql(
    "natural_left_join",
    TYPED + "," + PLAN_TYPED,
    """SELECT h.year, h.project, h.subproject, h.hours, p.code, p.subcode, p.budgeted
FROM (SELECT year, project, subproject, sum(hours) AS hours FROM typed GROUP BY ALL) h
LEFT JOIN plan p USING (year, project, subproject)""",
)
LABELLED = "docs AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
sql(
    "null_safe_join",
    LABELLED,
    "SELECT CAST(toxic AS BIGINT) AS toxic, count(*) AS n, count(quality) AS n_rated FROM docs GROUP BY toxic",
)
sql(
    "union_feeds",
    "",
    """SELECT o_orderkey, o_totalprice, o_orderpriority, NULL::BIGINT AS o_custkey FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_totalprice, NULL, o_custkey FROM orders WHERE o_orderstatus <> 'F'""",
)

# --------------------------------------------------------------- weekly balance


def _weeks(source: str, p: str = "", hours: str = "sum(hours)", target: str = "median(length) * 5") -> str:
    return f"""
weeks AS (SELECT {p}period, {hours} AS weekhours, {target} AS weektarget FROM {source} GROUP BY {p}period),
numbered AS (
  SELECT *, row_number() OVER w AS i, lead(1) OVER w IS NULL AS is_open,
    sum(weekhours) OVER w AS cumhours, sum(weektarget) OVER w AS cumtarget
  FROM weeks WINDOW w AS ({'PARTITION BY ' + p.rstrip(', ') if p else ''} ORDER BY period NULLS LAST)
)"""


sql(
    "weekly_constant",
    charges() + "," + _weeks("charges"),
    f"SELECT {TEXT_WEEK}, weekhours, cumhours, cumhours - (i - 1) * 36 AS balance FROM numbered",
)
sql(
    "weekly_current",
    charges() + "," + _weeks("charges"),
    f"SELECT {TEXT_WEEK}, weekhours, weektarget, cumhours, cumhours - (i - 1) * weektarget AS balance FROM numbered",
)
CUMULATIVE = (
    f"{TEXT_WEEK}, weekhours, weektarget, cumhours, cumtarget, "
    "CASE WHEN is_open THEN NULL ELSE cumhours - cumtarget END AS balance"
)
sql("weekly_cumulative", charges() + "," + _weeks("charges"), f"SELECT {CUMULATIVE} FROM numbered")
sql(
    "weekly_lagged",
    charges() + "," + _weeks("charges"),
    f"""SELECT {TEXT_WEEK}, weekhours, weektarget, cumhours, cumtarget - weektarget AS cumtarget,
  cumhours - (cumtarget - weektarget) AS balance FROM numbered""",
)
sql(
    "weekly_cumulative_by_person",
    charges("person") + "," + _weeks("charges", "person, "),
    f"SELECT person, {CUMULATIVE} FROM numbered",
)
sql(
    "weekly_strict_missing",
    TYPED_ALL + "," + _weeks("typed", "person, ", "CASE WHEN count(hours) = count(*) THEN sum(hours) END"),
    f"""SELECT person, {TEXT_WEEK}, weekhours, weektarget, strict AS cumhours, strict - (i - 1) * weektarget AS balance
FROM (SELECT *, CASE WHEN count(weekhours) OVER (PARTITION BY person ORDER BY period) = i THEN cumhours END AS strict FROM numbered)""",
)

# ------------------------------------------------------------------- week tables


def _sheet(ids: str, cell: str, source: str = "combined", by: str = "period", where: str = f"period > {DONE}") -> str:
    cells = ", ".join(f"max(CASE WHEN wday = '{d}' THEN h END) AS \"{d}\"" for d in WEEKDAYS)
    total = " + ".join(f'coalesce("{d}", 0)' for d in WEEKDAYS)
    return f"""
days AS (
  SELECT {ids}, strftime(date, '%a') AS wday, {cell} AS h FROM {source} WHERE {where} GROUP BY ALL
),
wide AS (SELECT {ids}, {cells} FROM days GROUP BY {ids}),
lines AS (SELECT *, {total} AS "Total" FROM wide),
sheet AS (
  SELECT *, coalesce(sum(CASE WHEN project <> 'ECONOMY' THEN "Total" END) OVER (PARTITION BY {by}), 0) AS "Sheet",
    sum("Total") OVER (PARTITION BY {by}) AS "Week"
  FROM lines
)"""


POSITIVE = "CASE WHEN sum(hours) > 0 THEN sum(hours) END"
DAY_COLS = ", ".join(f'"{d}"' for d in WEEKDAYS)
sql(
    "week_table_v7",
    combined() + "," + _sheet("period, project, code", POSITIVE),
    f'SELECT {TEXT_WEEK}, project, code, {DAY_COLS}, "Total", "Sheet", "Week" FROM sheet WHERE "Total" > 0',
)
sql(
    "week_table_by_person",
    combined("person") + "," + _sheet("person, period, project, code", POSITIVE, by="person, period"),
    f'SELECT person, {TEXT_WEEK}, project, code, {DAY_COLS}, "Total", "Sheet", "Week" FROM sheet WHERE "Total" > 0',
)
sql(
    "week_table_v4",
    plan_combined(True) + "," + _sheet("period, project, subproject, code, subcode", POSITIVE),
    f'SELECT {TEXT_WEEK}, project, subproject, code, subcode, {DAY_COLS}, "Total", "Week" FROM sheet WHERE "Total" > 0',
)
STRICT = "CASE WHEN count(hours) = count(*) THEN sum(hours) END"
sql(
    "week_table_v1",
    TYPED_ALL + "," + PLAN_TYPED + """,
coded AS (
  SELECT t.* EXCLUDE (code), p.code, p.subcode FROM typed t
  LEFT JOIN plan p ON t.year = p.year AND t.project = p.project AND t.subproject = p.subproject
),""" + _sheet("year, period, project, subproject, code, subcode", STRICT, "coded", "year, period", "TRUE"),
    f'SELECT {TEXT_WEEK}, project, {DAY_COLS}, "Total", "Week" FROM sheet WHERE period > {DONE}',
)
sql(
    "week_table_printable",
    combined() + "," + _sheet("period, project, code", POSITIVE),
    f"""SELECT {TEXT_WEEK}, project, code, {', '.join(f'''coalesce(printf('%.1f', "{c}"), ' - ') AS "{c}"''' for c in ('Mon', 'Sun', 'Total'))}
FROM sheet WHERE "Total" > 0""",
)
sql(
    "daily_hours",
    TYPED_ALL + "," + PLAN_TYPED,
    f"""SELECT d.year, CAST(d.period AS VARCHAR) AS period, CAST(d.date AS VARCHAR) AS date, d.project, d.subproject,
  p.code, p.subcode, d.dayhours, strftime(d.date, '%a') AS wday
FROM (SELECT date, period, year, project, subproject, {STRICT} AS dayhours FROM typed GROUP BY ALL) d
LEFT JOIN plan p ON d.year = p.year AND d.project = p.project AND d.subproject = p.subproject""",
)
WEEK_CELLS = ", ".join(f"sum(CASE WHEN strftime(date, '%a') = '{d}' THEN hours END) AS \"{d}\"" for d in WEEKDAYS)
sql("pivot_week", TYPED, f"SELECT {TEXT_WEEK}, project, {WEEK_CELLS} FROM typed GROUP BY typed.period, project")
sql("row_totals", TYPED, f'SELECT {TEXT_WEEK}, project, sum(hours) AS "Total" FROM typed GROUP BY typed.period, project')
sql(
    "spread_mean",
    "",
    "SELECT o_orderpriority, "
    + ", ".join(f"avg(floor(o_totalprice)) FILTER (o_orderstatus = '{s}') AS \"{s}\"" for s in "FOP")
    + " FROM orders GROUP BY o_orderpriority",
)
sql("gather_long", "", "SELECT o_orderpriority, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")

# ---------------------------------------------------------- months, years, charts
sql(
    "complete_project_month",
    charges("person") + """,
sums AS (SELECT person, project, month, sum(hours) AS hours FROM charges GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT person, project FROM sums) JOIN (SELECT DISTINCT person, month FROM sums) USING (person))""",
    """SELECT g.person, g.project, CAST(g.month AS VARCHAR) AS month, coalesce(s.hours, 0) AS hours
FROM grid g LEFT JOIN sums s ON g.person = s.person AND g.project = s.project AND g.month = s.month""",
)


def _monthly(p: str = "", budget: str = "") -> str:
    """rows(by, month, project2, code2, hours, length[, budgeted]) to lines."""
    by = p.rstrip(", ")
    on_by = f"AND g.{by} IS NOT DISTINCT FROM r.{by}" if p else ""
    grid = (
        f"(SELECT DISTINCT {by}, project2 FROM rows) JOIN (SELECT DISTINCT {by}, month FROM rows) USING ({by})"
        if p
        else "(SELECT DISTINCT project2 FROM rows) CROSS JOIN (SELECT DISTINCT month FROM rows)"
    )
    b = "r.budgeted, " if budget else ""
    agg = "greatest(0, coalesce(median(budgeted), 0)) AS budgeted, " if budget else ""
    return f"""
full_rows AS (
  SELECT g.*, {b}coalesce(r.hours, 0) AS hours, r.length, r.code2
  FROM (SELECT * FROM {grid}) g LEFT JOIN rows r ON g.project2 IS NOT DISTINCT FROM r.project2 AND g.month = r.month {on_by}
),
dated AS (
  SELECT * REPLACE (avg(length) OVER (PARTITION BY {p}month) AS length),
    CASE WHEN month(month) >= 6 THEN year(month) ELSE year(month) - 1 END AS year FROM full_rows
),
coded AS (SELECT * REPLACE (max(coalesce(code2, '0')) OVER (PARTITION BY {p}year, project2) AS code2) FROM dated),
lines AS (
  SELECT {p}year, month, length, project2, code2, {agg}greatest(0, sum(hours)) AS hours,
    round_even(median(length) * 119 / 8, 0) AS profile,
    nullif(regexp_extract(project2, '[A-Za-z]+'), '') AS project
  FROM coded GROUP BY {p}year, month, length, project2, code2
)"""


def _rows_v7(p: str = "") -> str:
    return f"""
rows AS (
  SELECT {p}month, CASE WHEN project IN {NPT} THEN 'NPT' ELSE project END AS project2,
    CASE WHEN project IN {NPT} THEN 'NPT' ELSE code END AS code2, hours, length
  FROM combined
)"""


MONTHLY_V7 = combined() + "," + _rows_v7() + "," + _monthly()
MONTH_COLS = "year, CAST(month AS VARCHAR) AS month, length, project2, code2, {b}hours, profile, project{c}"
sql("monthly_v7", MONTHLY_V7, f"SELECT {MONTH_COLS.format(b='', c='')} FROM lines")
sql(
    "monthly_by_person",
    combined("person") + "," + _rows_v7("person, ") + "," + _monthly("person, "),
    f"SELECT person, {MONTH_COLS.format(b='', c='')} FROM lines",
)
ROWS_V4 = """
rows AS (
  SELECT month, concat(coalesce(project, 'NA'), ' ', coalesce(subproject, 'NA')) AS project2,
    concat(coalesce(code, 'NA'), ' ', coalesce(subcode, 'NA')) AS code2, hours, length, budgeted
  FROM combined
)"""
ROWS_V6 = f"""
rows AS (
  SELECT month,
    CASE WHEN project IN {NPT} THEN 'NPT' ELSE concat(coalesce(project, 'NA'), ' ', coalesce(subproject, 'NA')) END AS project2,
    CASE WHEN project IN {NPT} THEN 'NPT' ELSE concat(coalesce(code, 'NA'), ' ', coalesce(subcode, 'NA')) END AS code2,
    hours, length, CASE WHEN project IN {NPT} THEN length / 8 * 55 ELSE budgeted END AS budgeted
  FROM combined
)"""


def _fitted(kept: str, counted: str) -> str:
    return f"""
kept AS (SELECT * FROM lines WHERE {kept}),
fitted AS (
  SELECT *, coalesce(sum(CASE WHEN {counted} THEN budgeted END) OVER (PARTITION BY month), 0) AS planned FROM kept
),
budget AS (
  SELECT * EXCLUDE (planned), round_even(
    CASE WHEN profile IS NULL THEN 0 ELSE budgeted * (CASE WHEN planned = 0 THEN 1 ELSE least(1, profile / planned) END) END, 1) AS budgeted2
  FROM fitted
)"""


BUDGET_V4 = plan_combined(False) + "," + ROWS_V4 + "," + _monthly(budget="y") + "," + _fitted(
    f"project IS NULL OR project NOT IN {NPT}", "TRUE"
)
BUDGET_V6 = plan_combined(True) + "," + ROWS_V6 + "," + _monthly(budget="y") + "," + _fitted("TRUE", "project <> 'NPT'")
sql("monthly_budget_v4", BUDGET_V4, f"SELECT {MONTH_COLS.format(b='budgeted, ', c=', budgeted2')} FROM budget")
sql("monthly_budget_v6", BUDGET_V6, f"SELECT {MONTH_COLS.format(b='budgeted, ', c=', budgeted2')} FROM budget")


def _flagged(extra: str = "") -> str:
    target = ", greatest(0, coalesce(median(monthtarget) OVER (PARTITION BY project), 0)) AS monthtarget" if extra else ""
    return f"""
levelled AS (
  SELECT project, month, monthhours, greatest(0, coalesce(median(monthbudget) OVER (PARTITION BY project), 0)) AS monthbudget{target}
  FROM by_month
),
flagged AS (SELECT *, bool_or(monthbudget <> 0 OR monthhours <> 0) OVER (PARTITION BY project) AS keep FROM levelled),
placed AS (SELECT project, row_number() OVER (ORDER BY month, monthbudget DESC, project) AS place FROM flagged),
ranked AS (SELECT project, row_number() OVER (ORDER BY min(place)) AS level FROM placed GROUP BY project)"""


def _moved(date: str) -> str:
    return f"CAST(date_trunc('month', CASE WHEN year({date}) = 2000 AND month({date}) = 2 THEN DATE '2000-03-01' ELSE {date} END) AS DATE)"


sql(
    "monthly_budget_v1",
    TYPED_ALL + "," + PLAN + f""",
scaled AS (
  SELECT project, CASE WHEN budgeted IS NOT NULL THEN greatest(0, budgeted * 101
    / (SELECT sum(budgeted) FROM plan_raw WHERE project NOT IN {NPT})) END AS budgeted FROM plan_raw
),
joined AS (
  SELECT coalesce(c.project, s.project) AS project, {_moved('c.date')} AS month, c.hours, s.budgeted
  FROM typed c FULL JOIN scaled s ON c.project = s.project
),
by_month AS (
  SELECT g.project, g.month, median(j.budgeted) AS monthbudget, coalesce(sum(j.hours), 0) AS monthhours
  FROM (SELECT * FROM (SELECT DISTINCT project FROM joined) CROSS JOIN (SELECT DISTINCT month FROM joined)) g
  LEFT JOIN joined j ON g.project = j.project AND g.month = j.month
  WHERE g.month IS NOT NULL GROUP BY ALL
),""" + _flagged(),
    """SELECT f.project, CAST(f.month AS VARCHAR) AS month, round(f.monthbudget, 6) AS monthbudget, f.monthhours, f.keep, r.level
FROM flagged f JOIN ranked r USING (project)""",
)
sql(
    "monthly_target_scale",
    plan_combined(True) + f""",
rows AS (SELECT project, {_moved('date')} AS month, hours, budgeted, length * 101 / 7.2::DOUBLE AS target FROM combined),
by_month AS (
  SELECT g.project, g.month, median(j.budgeted) AS monthbudget, coalesce(sum(j.hours), 0) AS monthhours, median(j.target) AS monthtarget
  FROM (SELECT * FROM (SELECT DISTINCT project FROM rows) CROSS JOIN (SELECT DISTINCT month FROM rows)) g
  LEFT JOIN rows j ON g.project = j.project AND g.month = j.month
  WHERE g.month IS NOT NULL GROUP BY ALL
),""" + _flagged("y"),
    f"""SELECT f.project, CAST(f.month AS VARCHAR) AS month, f.monthbudget, f.monthhours, round(f.monthtarget, 6) AS monthtarget, f.keep, r.level,
  round(CASE WHEN f.project IN {NPT} THEN f.monthbudget ELSE f.monthbudget * f.monthtarget
    / sum(CASE WHEN f.project NOT IN {NPT} THEN f.monthbudget END) OVER (PARTITION BY f.month) END, 6) AS monthbudget2
FROM flagged f JOIN ranked r USING (project)""",
)
sql(
    "yearly_totals_v7",
    MONTHLY_V7,
    """SELECT *, round_even(hours / months, 0) AS hours_month
FROM (SELECT year, project, count(DISTINCT month) AS months, round_even(sum(hours), 0) AS hours FROM lines GROUP BY year, project)
WHERE hours > 0""",
)


def _yearly_budget(profile: str) -> str:
    return f"""SELECT *, round_even(budget / months, 0) AS budget_month, round_even(hours / months, 0) AS hours_month
FROM (SELECT year, project, count(DISTINCT month) AS months{profile}, round_even(sum(budgeted), 0) AS budget,
  round_even(sum(hours), 0) AS hours FROM budget GROUP BY year, project)
WHERE budget + hours > 0"""


sql("yearly_totals_v4", BUDGET_V4, _yearly_budget(", median(profile) AS profile"))
sql("yearly_totals_v6", BUDGET_V6, _yearly_budget(""))
sql(
    "project_months",
    MONTHLY_V7,
    """SELECT year, project2, code2, CAST(month AS VARCHAR) AS month, hours
FROM (SELECT year, project2, code2, month, round_even(sum(hours), 0) AS hours FROM lines GROUP BY ALL)
WHERE hours > 0 AND project2 = 'STANDARD'""",
)
sql(
    "chart_weekly",
    charges() + "," + _weeks("charges"),
    """SELECT CAST(period AS VARCHAR) AS x, 'weekhours' AS series, weekhours AS value FROM numbered
UNION ALL SELECT CAST(period AS VARCHAR), 'balance', CASE WHEN is_open THEN NULL ELSE cumhours - cumtarget END FROM numbered""",
)
sql("chart_monthly", MONTHLY_V7, "SELECT CAST(month AS VARCHAR) AS x, project, 'hours' AS series, hours AS value FROM lines")
sql(
    "chart_budget",
    BUDGET_V6,
    " UNION ALL ".join(
        f"SELECT CAST(month AS VARCHAR) AS x, project, '{c}' AS series, {c} AS value FROM budget"
        for c in ("hours", "budgeted", "budgeted2")
    ),
)

# ------------------------------------------------- projections and expressions
sql(
    "sequential_columns",
    RAW,
    f"""SELECT person, CAST(d AS VARCHAR) AS date, CAST(period AS VARCHAR) AS period, project, code, hours,
  CAST(date_trunc('month', d) AS DATE)::VARCHAR AS month,
  CASE WHEN month(d) >= 6 THEN year(d) ELSE year(d) - 1 END AS year,
  coalesce(code IN ('C1', 'C2', 'C3'), false) AS known_code,
  CASE WHEN project IN {NPT} THEN 'NPT' ELSE project END AS kind
FROM (SELECT *, greatest(date, period) AS d FROM charges_raw) WHERE hours > 2""",
)
sql(
    "scalar_texts",
    RAW,
    """SELECT concat(project, ' ', coalesce(code, 'NA')) AS project2, 'Brand' AS letters, NULL::VARCHAR AS "none",
  coalesce(printf('%.1f', hours), ' - ') AS printed FROM charges_raw""",
)
sql(
    "scalar_dates",
    RAW,
    """SELECT DISTINCT date::VARCHAR AS date, strftime(date, '%a') AS label, isodow(date) - 1 AS place,
  CAST(date_trunc('month', date) AS DATE)::VARCHAR AS month,
  CASE WHEN month(date) >= 6 THEN year(date) ELSE year(date) - 1 END AS year,
  (CASE WHEN year(date) = 2000 AND month(date) = 2 THEN DATE '2000-03-01' ELSE date END)::VARCHAR AS moved
FROM charges_raw""",
)
sql(
    "week_grid",
    RAW,
    """SELECT period::VARCHAR AS period, (period + CAST(i AS INTEGER))::VARCHAR AS day
FROM (SELECT DISTINCT period FROM charges_raw) CROSS JOIN range(7) t(i)""",
)
sql(
    "null_helpers",
    RAW,
    """SELECT person, CASE WHEN hours > 5 THEN hours - 5 END AS positive, coalesce(hours, 0) AS or_zero,
  CASE WHEN hours > 5 THEN hours - 5 ELSE 0 END AS clamped,
  CASE WHEN hours > 5 THEN hours - 5 WHEN hours <= 5 THEN 0 END AS clamped_missing FROM charges_raw""",
)
sql("coalesce_first", LABELLED, "SELECT doc_id, CAST(coalesce(quality, toxic, -1) AS BIGINT) AS first_known FROM docs")
sql("null_if", "", "SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority FROM orders")
sql(
    "fill_const",
    LABELLED,
    "SELECT doc_id, lang, source, CAST(coalesce(quality, 0) AS BIGINT) AS quality, CAST(coalesce(toxic, -1) AS BIGINT) AS toxic FROM docs",
)
sql(
    "fill_with_max",
    RAW + "," + PLAN,
    "SELECT year, project, subproject, coalesce(enddate, (SELECT max(enddate) FROM plan_raw))::VARCHAR AS enddate FROM plan_raw",
)
sql(
    "drop_missing",
    RAW,
    """SELECT person, date::VARCHAR AS date, period::VARCHAR AS period, project, subproject, code, hours, length
FROM charges_raw WHERE code IS NOT NULL AND hours IS NOT NULL""",
)
sql(
    "apply_to_columns",
    RAW + "," + PLAN,
    """SELECT project, subproject, coalesce(printf('%.1f', budgeted), ' - ') AS budgeted, printf('%.1f', profile) AS profile FROM plan_raw""",
)
sql(
    "sort_missing_last",
    RAW + "," + PLAN,
    "SELECT year, project, subproject, budgeted FROM plan_raw ORDER BY year, budgeted DESC NULLS LAST, project, subproject",
)
sql("rename_count", "", "SELECT l_returnflag, l_linestatus, count(*) AS proportion FROM lineitem GROUP BY ALL")

# ------------------------------------------------------------------ aggregates
sql(
    "strict_vs_lenient_aggs",
    RAW,
    """SELECT person, project,
  CASE WHEN count(hours) = count(*) THEN sum(hours) END AS sum_strict, coalesce(sum(hours), 0) AS sum_lenient,
  CASE WHEN count(hours) = count(*) THEN median(hours) END AS median_strict, median(hours) AS median_lenient,
  avg(hours) AS mean_lenient, coalesce(sum(hours) FILTER (code IS NULL), 0) AS sum_uncoded,
  min(date)::VARCHAR AS first_date, max(code) AS max_code, bool_or(hours IS NULL) AS any_missing,
  bool_and(hours > 0) AS all_positive, avg(CAST(hours > 6 AS INTEGER)) AS share_long
FROM charges_raw GROUP BY ALL""",
)
sql("group_median", "", "SELECT l_returnflag, median(round(l_extendedprice * 100)) AS median FROM lineitem GROUP BY ALL")
sql("n_distinct_null", RAW, "SELECT person, count(DISTINCT coalesce(code, '')) AS n_codes FROM charges_raw GROUP BY person")
sql("distinct_weeks", TYPED, "SELECT DISTINCT year, month::VARCHAR AS month, period::VARCHAR AS period FROM typed")
sql(
    "group_values_to_rows",
    TYPED,
    """SELECT project, CAST(m AS VARCHAR) AS month, hours, sum(hours) OVER (PARTITION BY m) AS month_hours, sum(hours) OVER () AS all_hours
FROM (SELECT project, month AS m, sum(hours) AS hours FROM typed GROUP BY ALL)""",
)
sql(
    "first_appearance_rank",
    RAW + "," + PLAN + """,
lines AS (SELECT year, subproject, sum(budgeted) AS budget FROM plan_raw GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (ORDER BY year, budget DESC NULLS LAST, subproject) AS place FROM lines)""",
    "SELECT subproject, row_number() OVER (ORDER BY min(place)) AS rank FROM placed GROUP BY subproject",
)
sql(
    "share_scaling",
    RAW + "," + PLAN,
    f"""SELECT year, project, subproject, budgeted,
  budgeted * 101 / sum(CASE WHEN project NOT IN {NPT} THEN budgeted END) OVER (PARTITION BY year) AS scaled FROM plan_raw""",
)
sql(
    "number_rows",
    "",
    """SELECT l_returnflag, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq
FROM lineitem""",
)

# ----------------------------------------------------------------- tabulations
sql(
    "tabyl_one_way",
    "",
    """SELECT o_orderpriority, n, n / sum(n) OVER () AS percent, n / sum(n) OVER () AS valid_percent
FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)""",
)
sql(
    "tabyl_one_way_na",
    LABELLED,
    """SELECT CAST(quality AS BIGINT) AS quality, n, n / sum(n) OVER () AS percent,
  CASE WHEN quality IS NOT NULL THEN n / sum(n) FILTER (quality IS NOT NULL) OVER () END AS valid_percent
FROM (SELECT quality, count(*) AS n FROM docs GROUP BY ALL)""",
)
sql(
    "tabyl_hide_na",
    LABELLED,
    """SELECT CAST(quality AS BIGINT) AS quality, n, n / sum(n) OVER () AS percent, n / sum(n) OVER () AS valid_percent
FROM (SELECT quality, count(*) AS n FROM docs WHERE quality IS NOT NULL GROUP BY ALL)""",
)
sql(
    "tabyl_two_way",
    LABELLED,
    """SELECT lang, count(*) FILTER (quality = 0)::DOUBLE AS "0", count(*) FILTER (quality = 1)::DOUBLE AS "1",
  count(*) FILTER (quality IS NULL)::DOUBLE AS "NA_" FROM docs GROUP BY lang""",
)
sql(
    "tabyl_three_way",
    "",
    """SELECT c_acctbal > 0 AS solvent, c_mktsegment, CAST(n_regionkey AS BIGINT) AS n_regionkey, count(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
)
sql(
    "tabyl_missing_levels",
    "levels AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NEVER']) AS o_orderpriority)",
    """SELECT l.o_orderpriority, count(o_orderkey) AS n, count(o_orderkey) / (SELECT count(*) FROM orders) AS percent,
  count(o_orderkey) / (SELECT count(*) FROM orders) AS valid_percent
FROM levels l LEFT JOIN orders o ON l.o_orderpriority = o.o_orderpriority GROUP BY ALL""",
)
sql(
    "tabyl_two_way_levels",
    "grid AS (SELECT s AS o_orderstatus, p AS o_orderpriority FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS s) CROSS JOIN "
    "(SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NEVER']) AS p))",
    "SELECT o_orderstatus, o_orderpriority, count(o_orderkey) AS n FROM grid LEFT JOIN orders USING (o_orderstatus, o_orderpriority) GROUP BY ALL",
)


def _by_priority(cell: str, extra: str = "") -> str:
    return ", ".join(cell.replace("?", f"o_orderpriority = '{p}'") + f' AS "{p}"' for p in PRIORITIES) + extra


sql(
    "adorn_totals_both",
    "",
    f"""SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'Total' ELSE o_orderstatus END AS o_orderstatus,
  {_by_priority('count(*) FILTER (?)::DOUBLE')}, count(*)::DOUBLE AS "Total" FROM orders GROUP BY ROLLUP (o_orderstatus)""",
)
sql(
    "adorn_totals_long",
    LABELLED,
    """SELECT source, lang, CAST(quality AS BIGINT) AS quality, grouping(lang) = 1 AS row_total, grouping(quality) = 1 AS col_total, count(*) AS n
FROM docs GROUP BY GROUPING SETS ((source, lang, quality), (source, lang), (source, quality), (source))""",
)
for _name, _part in (("row", "PARTITION BY l_returnflag"), ("col", "PARTITION BY l_linenumber"), ("all", "")):
    sql(
        f"adorn_pct_{_name}",
        "",
        f"""SELECT l_returnflag, CAST(l_linenumber AS BIGINT) AS l_linenumber, n, n / sum(n) OVER ({_part}) AS share
FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)""",
    )
HALF_UP = "floor({x} * {s} + 0.5 + 1e-9) / {s}"
sql(
    "adorn_rounding",
    "",
    f"""SELECT o_orderstatus, {_by_priority(HALF_UP.format(x='(count(*) FILTER (?) / any_value(t))', s='1000'))}
FROM orders CROSS JOIN (SELECT count(*) AS t FROM orders) GROUP BY o_orderstatus""",
)
SHARE_TEXT = "printf('%.{d}f%%', floor(100 * {x} * {s} + 0.5 + 1e-9) / {s})"
sql(
    "adorn_pct_text",
    "totals AS (SELECT o_orderpriority, count(*) AS t FROM orders GROUP BY ALL)",
    f"""SELECT o_orderstatus, {_by_priority(SHARE_TEXT.format(d=2, s='100', x='count(*) FILTER (?) / any_value(t) FILTER (?)'))}
FROM orders JOIN totals USING (o_orderpriority) GROUP BY o_orderstatus""",
)
COMMA = "format('{:,}', count(*) FILTER (?))"
sql(
    "adorn_ns",
    "",
    "SELECT o_orderstatus, "
    + _by_priority(f"concat({COMMA}, ' (', {SHARE_TEXT.format(d=0, s='1', x='count(*) FILTER (?) / count(*)')}, ')')")
    + " FROM orders GROUP BY o_orderstatus",
)
sql(
    "adorn_full_chain",
    "",
    "SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'Total' ELSE o_orderstatus END AS \"Status/Priority\", "
    + _by_priority(f"concat({SHARE_TEXT.format(d=1, s='10', x='count(*) FILTER (?) / count(*)')}, ' (', {COMMA}, ')')")
    + ", concat('100.0% (', format('{:,}', count(*)), ')') AS \"Total\" FROM orders GROUP BY ROLLUP (o_orderstatus)",
)
sql(
    "adorn_one_way",
    "",
    f"""SELECT CASE WHEN grouping(lang) = 1 THEN 'Total' ELSE lang END AS lang, count(*) AS n,
  {SHARE_TEXT.format(d=1, s='10', x='count(*) / any_value(t)')} AS percent
FROM documents CROSS JOIN (SELECT count(*) AS t FROM documents) GROUP BY ROLLUP (lang)""",
)
sql(
    "adorn_three_way",
    "",
    "SELECT l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN 'Total' ELSE l_linestatus END AS \"l_linestatus/l_linenumber\", "
    + ", ".join(
        "concat("
        + SHARE_TEXT.format(d=1, s="10", x=f"count(*) FILTER (l_linenumber = {i}) / any_value(t)")
        + f", ' (', format('{{:,}}', count(*) FILTER (l_linenumber = {i})), ')') AS \"{i}\""
        for i in range(1, 8)
    )
    + " FROM lineitem JOIN (SELECT l_returnflag, count(*) AS t FROM lineitem GROUP BY ALL) USING (l_returnflag)"
    + " GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))",
)
sql(
    "adorn_chosen_column",
    "",
    f"""SELECT o_orderstatus, year(o_orderdate) AS year, {SHARE_TEXT.format(d=1, s='10', x='count(*) / any_value(t)')} AS proportion
FROM orders CROSS JOIN (SELECT count(*) AS t FROM orders) GROUP BY o_orderstatus, year(o_orderdate)""",
)
sql(
    "adorn_any_frame",
    """frame AS (
  SELECT n_name, n_regionkey, count(*) FILTER (c_acctbal > 0) AS solvent, count(*) FILTER (c_acctbal <= 0) AS owing
  FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)""",
    """SELECT n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, solvent, owing, solvent + owing AS "Total Cases" FROM frame
UNION ALL SELECT 'Total Cases', '-', CAST(sum(solvent) AS BIGINT), CAST(sum(owing) AS BIGINT), CAST(sum(solvent + owing) AS BIGINT) FROM frame""",
)
sql(
    "adorn_frame_shares",
    "totals AS (SELECT o_orderstatus, count(*) AS t FROM orders GROUP BY ALL)",
    "SELECT o_orderpriority, "
    + ", ".join(
        SHARE_TEXT.format(d=1, s="10", x=f"count(*) FILTER (o_orderstatus = '{s}') / any_value(t) FILTER (o_orderstatus = '{s}')")
        + f' AS "{s}"'
        for s in "FOP"
    )
    + " FROM orders JOIN totals USING (o_orderstatus) GROUP BY o_orderpriority",
)
sql(
    "adorn_frame_ns",
    "",
    'SELECT o_orderpriority AS "Priority/Status", '
    + ", ".join(
        f"concat(printf('%.1f', floor(avg(floor(o_totalprice)) FILTER (o_orderstatus = '{s}') + 0.5)), ' (', "
        f"format('{{:,}}', count(*) FILTER (o_orderstatus = '{s}')), ')') AS \"{s}\""
        for s in "FOP"
    )
    + " FROM orders GROUP BY o_orderpriority",
)
sql(
    "top_levels_priority",
    "",
    """SELECT place, levels, n, n / sum(n) OVER () AS percent FROM (
  SELECT CASE WHEN o_orderpriority <= '2-HIGH' THEN 'head' WHEN o_orderpriority <= '3-MEDIUM' THEN 'middle' ELSE 'tail' END AS place,
    string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS levels, count(*) AS n
  FROM orders GROUP BY ALL)""",
)
sql(
    "quantile_bins_price",
    "q AS (SELECT min(o_totalprice) AS a, quantile_cont(o_totalprice, 1 / 3) AS b, quantile_cont(o_totalprice, 2 / 3) AS c FROM orders)",
    """SELECT o_orderkey, o_totalprice,
  CASE WHEN o_totalprice <= a THEN NULL WHEN o_totalprice <= b THEN 'low' WHEN o_totalprice <= c THEN 'middle' ELSE 'high' END AS third
FROM orders CROSS JOIN q""",
)

_PRIORITY_CELLS = ", ".join(f"count(*) FILTER (o_orderpriority = '{p}')::DOUBLE AS \"{p}\"" for p in PRIORITIES)
sql(
    "tabyl_column_named_n",
    "",
    f"""SELECT o_orderstatus AS row_total, {_PRIORITY_CELLS}, count(*)::DOUBLE AS "Total" FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'Total', {_PRIORITY_CELLS}, count(*)::DOUBLE FROM orders""",
)
sql(
    "tabyl_column_named_value",
    "",
    """SELECT s AS value, p AS n, k AS n_2, FALSE AS row_total, FALSE AS col_total, k / sum(k) OVER (PARTITION BY s) AS value_2
FROM (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS k FROM orders GROUP BY ALL)""",
)
sql(
    "tabyl_one_way_named_n",
    "",
    "SELECT o_orderpriority AS n, count(*) AS n_2, count(*) / sum(count(*)) OVER () AS percent, count(*) / sum(count(*)) OVER () AS valid_percent FROM orders GROUP BY ALL",
)
sql(
    "tabyl_label_clash",
    "",
    """SELECT lang, count(*) FILTER (doc_id % 5 = 2)::DOUBLE AS emptystring_, count(*) FILTER (doc_id % 5 = 0)::DOUBLE AS "NA_",
  count(*) FILTER (doc_id % 5 = 1)::DOUBLE AS "Total", count(*) FILTER (doc_id % 5 = 4)::DOUBLE AS other,
  count(*) FILTER (doc_id % 5 = 3)::DOUBLE AS "NA__2", count(*)::DOUBLE AS "Total_2" FROM documents GROUP BY lang""",
)
sql(
    "tabyl_ordered_levels",
    "counted AS (SELECT o_orderpriority, o_orderstatus FROM orders UNION ALL SELECT 'Total', o_orderstatus FROM orders)",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'P')::DOUBLE AS "P", 0::DOUBLE AS "X", count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS "F",
  count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS "O" FROM counted GROUP BY o_orderpriority""",
)
_STATUS_CELLS = "o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS \"{s}\"" for s in "FOP") + ", count(*) AS t"
_STATUS_FRAME = f"""cells AS (
  SELECT {_STATUS_CELLS} FROM orders GROUP BY o_orderpriority
  UNION ALL SELECT {_STATUS_CELLS.replace("o_orderpriority", "'Total'", 1)} FROM orders),
whole AS (SELECT * FROM cells WHERE o_orderpriority = 'Total')"""
sql(
    "adorn_frame_totals_then_shares",
    _STATUS_FRAME,
    """SELECT c.o_orderpriority, c."F" / w."F" AS "F", c."O" / w."O" AS "O", c."P" / w."P" AS "P", c.t / w.t AS "Total" FROM cells c, whole w""",
)
sql(
    "adorn_frame_totals_ns",
    _STATUS_FRAME,
    "SELECT c.o_orderpriority, "
    + ", ".join(
        f"concat(CAST(floor(c.{c} * 100 / w.t + 0.5) AS BIGINT), '% (', format('{{:,}}', c.{c}), ')') AS \"{n}\"" for c, n in (('"F"', "F"), ('"O"', "O"), ('"P"', "P"), ("t", "Total"))
    )
    + " FROM cells c, whole w",
)

# ------------------------------------------------------------------- tests


def _chisq(source: str, a: str, b: str) -> str:
    return f"""
cells AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
grid AS (
  SELECT coalesce(o, 0) AS o, r * c / t AS e FROM (SELECT a, sum(o)::DOUBLE AS r FROM cells GROUP BY a)
  CROSS JOIN (SELECT b, sum(o)::DOUBLE AS c FROM cells GROUP BY b) CROSS JOIN (SELECT sum(o)::DOUBLE AS t FROM cells)
  LEFT JOIN cells USING (a, b)
)"""


DOF = "(SELECT (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) FROM cells) AS dof, CAST((SELECT sum(o) FROM cells) AS BIGINT) AS n"
sql("chisq_stat", _chisq("orders", "o_orderstatus", "o_orderpriority"), f"SELECT round(sum((o - e) ^ 2 / e), 6) AS statistic, {DOF} FROM grid")
sql(
    "chisq_2x2_corrected",
    _chisq("labels", "quality", "toxic"),
    f"SELECT round(sum((abs(o - e) - least(0.5, abs(o - e))) ^ 2 / e), 6) AS statistic, {DOF} FROM grid",
)
# Eight degrees of freedom: the tail has the closed form exp(-h) * sum(h^k / k!), k = 0..3.
sql(
    "chisq_pvalue",
    _chisq("orders", "o_orderstatus", "o_orderpriority"),
    f"""SELECT round(s, 6) AS statistic, dof, n, round(exp(-s / 2) * (1 + s / 2 + (s / 2) ^ 2 / 2 + (s / 2) ^ 3 / 6), 6) AS p_value
FROM (SELECT sum((o - e) ^ 2 / e) AS s, {DOF} FROM grid)""",
)
sql(
    "fisher_by_group",
    """cells AS (
  SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS n11, count(*) FILTER (quality = 1 AND toxic = 0) AS n10,
    count(*) FILTER (quality = 0 AND toxic = 1) AS n01, count(*) FILTER (quality = 0 AND toxic = 0) AS n00
  FROM documents JOIN labels USING (doc_id) GROUP BY lang),
tables AS (
  SELECT *, unnest(generate_series(greatest(0, n11 + n10 + n11 + n01 - (n11 + n10 + n01 + n00)), least(n11 + n10, n11 + n01))) AS k FROM cells),
probs AS (
  SELECT *, exp(lgamma(n11 + n10 + 1) + lgamma(n01 + n00 + 1) + lgamma(n11 + n01 + 1) + lgamma(n10 + n00 + 1)
    - lgamma(n11 + n10 + n01 + n00 + 1) - lgamma(k + 1) - lgamma(n11 + n10 - k + 1) - lgamma(n11 + n01 - k + 1)
    - lgamma(n00 - n11 + k + 1)) AS p FROM tables),
seen AS (SELECT lang, p AS p0 FROM probs WHERE k = n11)""",
    """SELECT lang, n11, n10, n01, n00, round(least(1, sum(CASE WHEN p <= p0 * (1 + 1e-7) THEN p ELSE 0 END)), 8) AS p_value
FROM probs JOIN seen USING (lang) GROUP BY ALL""",
)

# ---------------------------------------------------------- cleaning, relations
sql(
    "get_dupes_lineitem",
    "",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, dupe_count, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate::VARCHAR AS l_shipdate
FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS dupe_count FROM lineitem) WHERE dupe_count > 1""",
)
sql(
    "get_dupes_text",
    "",
    """SELECT doc_id, lang, source, n_chars, dupe_count
FROM (SELECT *, count(*) OVER (PARTITION BY text) AS dupe_count FROM documents) WHERE dupe_count > 1""",
)
sql(
    "get_dupes_all_columns",
    "",
    """SELECT l_partkey, l_suppkey, l_returnflag, dupe_count
FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag) AS dupe_count FROM lineitem) WHERE dupe_count > 1""",
)
sql(
    "single_value_report",
    RAW,
    """SELECT person, project, subproject, min(code) AS first_value, max(code) AS other_value, count(*) AS n
FROM charges_raw GROUP BY ALL HAVING count(DISTINCT code) > 1""",
)
sql(
    "single_value_fill",
    "",
    """SELECT c_custkey, n_name, max(CASE WHEN c_acctbal > 1000 THEN r_name END) OVER (PARTITION BY n_name) AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
_RELATION_COLS = ["c_custkey", "c_name", "c_nationkey", "n_name", "n_regionkey", "r_name", "c_mktsegment"]
_PAIRS = " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, '{b}' AS column_name, count(DISTINCT {a}) = count(DISTINCT ({a}, {b})) "
    f"AND count(DISTINCT {b}) = count(DISTINCT ({a}, {b})) AS same FROM w"
    for i, a in enumerate(_RELATION_COLS)
    for j, b in enumerate(_RELATION_COLS)
)
sql(
    "one_to_one_columns",
    "w AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),\n"
    f"pairs AS ({_PAIRS}),\n"
    "heads AS (SELECT j, column_name, min(i) AS head, count(*) AS size FROM pairs WHERE same GROUP BY ALL)",
    "SELECT dense_rank() OVER (ORDER BY head) AS cluster, column_name FROM heads WHERE size > 1",
)
GAPPY = """
gappy AS (
  SELECT CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END AS key, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price,
    NULL::VARCHAR AS nothing, CASE WHEN o_orderstatus <> 'F' AND o_orderpriority > '3' THEN o_orderpriority END AS priority, 'x' AS constant
  FROM orders)"""
sql("remove_empty_rows", GAPPY, "SELECT key, price, nothing, priority FROM gappy WHERE key IS NOT NULL OR price IS NOT NULL OR priority IS NOT NULL")
sql("remove_empty_cols", GAPPY, "SELECT key, price, priority, constant FROM gappy")
# At most one of the five cells may be missing; the empty column always is.
sql("remove_empty_cutoff", GAPPY, "SELECT key, price, priority, constant FROM gappy WHERE key IS NOT NULL AND price IS NOT NULL AND priority IS NOT NULL")
sql("remove_constant", GAPPY, "SELECT key, price, nothing, priority FROM gappy".replace("nothing, ", ""))

# ------------------------------------------------------------ dates, rounding
sql(
    "excel_dates",
    "",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE)::VARCHAR AS modern, CAST(o_orderdate AS DATE)::VARCHAR AS mac,
  CAST(o_orderdate + to_seconds((o_orderkey % 96) * 900) AS VARCHAR) AS with_time,
  CASE WHEN o_orderkey + 1 = 60 THEN NULL WHEN o_orderkey + 1 < 60 THEN (DATE '1899-12-31' + CAST(o_orderkey + 1 AS INTEGER))::VARCHAR
    ELSE (DATE '1899-12-30' + CAST(o_orderkey + 1 AS INTEGER))::VARCHAR END AS early
FROM orders""",
)
sql(
    "sas_dates",
    "",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE)::VARCHAR AS day,
  CAST(date_trunc('day', o_orderdate) + to_seconds(o_orderkey % 86400) AS VARCHAR) AS moment, (o_orderkey % 86400) // 3600 AS hour FROM orders""",
)
sql(
    "mixed_dates",
    "",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE)::VARCHAR END AS day,
  CASE WHEN o_orderkey % 4 = 1 THEN CAST(date_trunc('day', o_orderdate)::TIMESTAMP AS VARCHAR)
    WHEN o_orderkey % 4 < 3 THEN CAST(date_trunc('day', o_orderdate) + INTERVAL 6 HOUR AS VARCHAR) END AS moment
FROM orders""",
)
sql(
    "rounding_suite",
    "",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round_even(l_quantity / 2, 0) AS half_even,
  floor(l_quantity / 2 + 0.5) AS half_up, -floor(l_quantity / 2 + 0.5) AS half_up_negative,
  floor(floor(l_extendedprice) / s + 0.5) * s AS two_digits,
  floor(l_discount * 4 + 0.5) / 4 AS quarters,
  floor(floor(l_quantity / 7 * 3 + 0.5) / 3 * 100 + 0.5) / 100 AS thirds
FROM (SELECT *, 10::DOUBLE ^ (floor(log10(floor(l_extendedprice))) - 1) AS s FROM lineitem)""",
)

# --------------------------------------------------------------- names, feeds
sql("clean_names_orders", "", "SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_totalprice AS percent_total_2009 FROM orders")
sql(
    "normalize_values_part",
    "",
    """SELECT p_partkey, concat(upper(p_name), ' % ', p_brand) AS text,
  concat(replace(lower(p_name), ' ', '_'), '_percent_', replace(lower(p_brand), '#', '_number_')) AS clean FROM part""",
)
sql(
    "normalize_values_numbered",
    "",
    """SELECT p_partkey, text, CASE WHEN i = 1 THEN lower(text) ELSE concat(lower(text), '_', i) END AS clean
FROM (SELECT p_partkey, p_type AS text, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS i FROM part)""",
)
sql(
    "normalize_values_taken",
    """named AS (
  SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('Size ', p_size) ELSE 'size' END AS text,
    CASE WHEN p_partkey % 3 = 0 THEN concat('size_', p_size) ELSE 'size' END AS base FROM part),
seq AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS i FROM named),
free AS (
  SELECT base, k, row_number() OVER (PARTITION BY base ORDER BY k) + 1 AS i
  FROM (SELECT DISTINCT base FROM named), (SELECT unnest(range(2, (SELECT 2 * count(*) + 2 FROM part))) AS k)
  WHERE concat(base, '_', k) NOT IN (SELECT base FROM named))""",
    """SELECT p_partkey, text, CASE WHEN seq.i = 1 THEN base ELSE concat(base, '_', k) END AS clean
FROM seq LEFT JOIN free USING (base, i)""",
)
sql(
    "mixed_dates_report",
    "",
    """SELECT 'text' AS column_name, count(*) AS rows, count(*) FILTER (o_orderkey % 7 = 1) AS missing, count(*) FILTER (o_orderkey % 7 = 0) AS unreadable,
  count(*) FILTER (o_orderkey % 7 = 2 AND o_orderkey % 90 - 5 < 1) AS not_positive,
  count(*) FILTER (o_orderkey % 7 = 2 AND o_orderkey % 90 - 5 = 60) AS no_such_day, 0::BIGINT AS skipped_hour FROM orders""",
)
sql(
    "quality_report",
    LABELLED,
    """SELECT source, count(*) AS rejects, (SELECT count(*) FROM docs) AS rows, (SELECT count(*) FROM docs WHERE quality IS NULL OR lang IS NULL) AS rejected,
  (SELECT count(*) FROM docs WHERE quality IS NULL) AS missing_quality FROM docs WHERE quality IS NULL OR lang IS NULL GROUP BY source""",
)
sql(
    "find_header",
    "",
    """SELECT o_orderstatus AS feed, CAST(3 AS BIGINT) AS header_row,
  CASE WHEN o_orderstatus = 'O' THEN 'orderKey|Priority|Customer #' ELSE 'Order Key|Priority|Customer #' END AS names
FROM orders GROUP BY o_orderstatus""",
)
sql("find_header_value", "", "SELECT o_orderstatus AS feed, CAST(3 AS BIGINT) AS header_row FROM orders GROUP BY o_orderstatus")
sql(
    "header_to_names",
    "",
    """SELECT o_orderstatus AS feed, CAST(o_orderkey AS VARCHAR) AS order_key, nullif(o_orderpriority, '5-LOW') AS priority,
  CAST(o_custkey AS VARCHAR) AS customer_number FROM orders""",
)


def _audit_row(feed: str, column: str, kind: str | None, common: str, agrees: str, n: str, misfits: str, where: str) -> str:
    kind = f"'{kind}'" if kind else "NULL::VARCHAR"
    return (
        f"SELECT '{feed}' AS feed, '{column}' AS column_name, {kind} AS type, '{common}' AS common_type, {agrees} AS agrees, "
        f"{n} AS n_values, {misfits} AS n_misfits FROM orders WHERE o_orderstatus = '{where}'"
    )


NONE, ALL = "0 * count(*)", "count(*)"


def _audit(strict: bool) -> list[str]:
    rows = []
    for feed, status in (("closed", "F"), ("open", "O"), ("partial", "P")):
        if not strict:
            rows.append(_audit_row(feed, "o_orderkey", "bigint", "bigint", "true", ALL, NONE, status))
        price = "double" if feed == "closed" else "string"
        bad = "count(*) FILTER (o_custkey % 10 = 0)" if feed == "partial" else NONE
        rows.append(_audit_row(feed, "o_totalprice", price, "double", "false", ALL, bad, status))
        text = "string" if feed == "closed" else None
        rows.append(_audit_row(feed, "o_orderpriority", text, "string", "false" if strict else "true", ALL if text else NONE, NONE, status))
        kind = {"closed": None, "open": "int", "partial": "bigint"}[feed]
        rows.append(_audit_row(feed, "o_custkey", kind, "bigint", "false", ALL if kind else NONE, NONE, status))
    return rows


sql("audit_feeds", "", "\nUNION ALL ".join(_audit(False)))
sql("audit_feeds_mismatch", "", "\nUNION ALL ".join(_audit(True)))
sql(
    "feeds_match",
    "found AS (" + "\nUNION ALL ".join(_audit(False)) + ")",
    "SELECT column_name, bool_and(agrees) AS agrees, CAST(sum(n_misfits) AS BIGINT) AS n_misfits FROM found GROUP BY column_name",
)
sql(
    "group_quantiles_price",
    "cents AS (SELECT l_returnflag, l_linestatus, round(l_extendedprice * 100) AS x FROM lineitem)",
    """SELECT l_returnflag, l_linestatus, round(quantile_cont(x, 0.1), 3) AS p10, round(quantile_cont(x, 0.5), 3) AS p50,
  round(quantile_cont(x, 0.9), 3) AS p90 FROM cents GROUP BY ALL""",
)
sql(
    "carry_forward_events",
    "",
    """SELECT event_id, event_type, last_value(CASE WHEN value >= 5 THEN value END IGNORE NULLS) OVER (
  PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events""",
)
sql(
    "complete_three_keys",
    "n AS (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)",
    """SELECT o_custkey, o_orderstatus, o_orderpriority, coalesce(n, 0) AS n
FROM (SELECT * FROM (SELECT DISTINCT o_custkey FROM orders), (SELECT DISTINCT o_orderstatus FROM orders),
  (SELECT DISTINCT o_orderpriority FROM orders))
LEFT JOIN n USING (o_custkey, o_orderstatus, o_orderpriority)""",
)
sql(
    "binned_validity_join",
    "",
    """SELECT a.o_custkey, a.o_orderkey, a.o_orderdate::DATE::VARCHAR AS date, b.o_orderkey AS open_order, b.o_orderdate::DATE::VARCHAR AS startdate,
  (b.o_orderdate::DATE + (b.o_orderkey % 400)::INT)::VARCHAR AS enddate
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate::DATE BETWEEN b.o_orderdate::DATE AND b.o_orderdate::DATE + (b.o_orderkey % 400)::INT""",
)
sql(
    "fill_with_max_by",
    "known AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS x FROM customer)",
    """SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, coalesce(x, max(x) OVER (PARTITION BY c_nationkey)) AS c_acctbal FROM known""",
)
