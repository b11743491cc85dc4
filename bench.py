"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the timed runs per
query (the median counts). Each query runs once untimed first; results go to the no-op sink, so every
column of every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from lectern.plans.catalog import QUERIES
from lectern.session import local_session

HEADLINE = (
    "v1_shelf_utilization",
    "v2_book_inventory",
    "v4_books_by_shelf",
    "v5_active_loans",
    "v6_overdue_loans",
    "v7_loan_history",
    "f6_search_books",
    "f16_loans_of_students",
    "f18_loans_with_details",
    "j7_never_loaned",
    "a4_shelves_by_section",
    "a8_book_statistics",
    "a9_loan_statistics",
    "a10_student_loan_summary",
    "a12_loans_by_month",
    "a14_student_history",
    "a15_popular_books",
    "a16_students_with_several_active",
    "a18_section_popularity",
    "a20_shelf_consistency",
    "a22_health",
    "u2_orphan_checks",
    "u3_usage_summary",
    "dq_books_strict",
    "dq_loans_strict",
    "dq28_set_checks",
    "l1_admit_loans",
    "l2_loans_after_returns",
    "l3_loans_after_renewals",
    "l5_mark_overdue",
    "l6_book_status_after_returns",
    "p1_place_books",
    "p3_shelf_deltas",
    "p4_fix_capacity_counts",
    "w1_students_after_patches",
    "w2_loans_after_student_delete",
    "cdc1_audit_overdue",
    "snk1_ingest_books",
    "p2_moves_result",
    "st1_loan_events",
)
# Four micro-batches of many small jobs, over a minute long: run once, without a run to warm up.
LONG = {"st1_loan_events"}


def timed(spark, name: str, folder: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, "lectern-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        if name in LONG:
            seconds[name] = round(timed(spark, name, folder), 3)
            continue
        timed(spark, name, folder)
        seconds[name] = round(statistics.median(timed(spark, name, folder) for _ in range(runs)), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": scale,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
