"""Run registered queries and their SQL side by side and compare all values."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def _key(row):
    return [(v is None, type(v).__name__, v) for v in row]


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty text when equal, else what differs."""
    got = entry.queries()[name](spark, sf_dir)
    order = sorted(got.columns)
    rows = sorted(([_plain(v) for v in r] for r in got.select(*[f"`{c}`" for c in order]).collect()), key=_key)
    result = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in result.description]
    if sorted(cols) != order:
        return f"columns {order} against {sorted(cols)}"
    pick = [cols.index(c) for c in order]
    want = sorted(([_plain(r[i]) for i in pick] for r in result.fetchall()), key=_key)
    if len(rows) != len(want):
        return f"{len(rows)} rows against {len(want)}"
    for a, b in zip(rows, want):
        for c, x, y in zip(order, a, b):
            if x != y or type(x) is not type(y):
                return f"column {c}: {x!r} against {y!r} in {dict(zip(order, a))} / {dict(zip(order, b))}"
    return "" if rows else "EMPTY RESULT"


if __name__ == "__main__":
    from worktally.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in sys.argv[1:] or entry.queries():
        start = time.time()
        try:
            verdict = compare(spark, con, name, sf) if name in entry.oracle_sql() else "no SQL"
        except Exception as e:  # noqa: BLE001
            verdict = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(verdict)
        print(f"{name:32s} {time.time() - start:6.2f}s {verdict or 'ok'}", flush=True)
    print("differences:", bad)
