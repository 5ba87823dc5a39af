"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_REPEAT the
timed runs of each query, of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from worktally.catalog.queries import QUERIES  # noqa: E402
from worktally.session import local_session  # noqa: E402

HEADLINES = [
    "prepare_charges",
    "weekly_cumulative",
    "weekly_cumulative_by_person",
    "week_table_v7",
    "monthly_v7",
    "monthly_by_person",
    "monthly_budget_v6",
    "monthly_budget_v1",
    "yearly_totals_v7",
    "tabyl_two_way",
    "adorn_full_chain",
    "chisq_stat",
    "get_dupes_lineitem",
    "get_dupes_text",
    "quantile_bins_price",
    "one_to_one_columns",
    "excel_dates",
    "header_to_names",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, HEADLINES[0], sf_dir)  # warm-up
    times = {}
    for name in HEADLINES:
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(repeat)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "spark": spark.version,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                "runs": repeat,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
