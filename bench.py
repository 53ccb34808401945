"""Run the headline queries once warm and print one JSON line with their times."""

from __future__ import annotations

import json
import os
import time

from tallyspark.catalog import QUERIES
from tallyspark.session import drop_staged, local_session

HEADLINE = (
    "monthly_summary",
    "spending_by_category",
    "category_month_matrix",
    "search_transactions",
    "export_ledger",
    "classify_all",
    "rule_audit",
    "classify_many_rules",
    "dedupe_card_feed",
    "dedupe_snapshots",
    "append_new",
    "check_totals",
    "check_chain",
    "import_report",
    "import_statement_report",
    "net_worth",
    "running_balance",
    "savings_goal_summary",
    "savings_projection",
    "extract_scoped_rows",
    "assemble_records",
    "words_to_lines",
    "stage_card_rows",
    "stage_sectioned_movements",
    "stage_xml_block",
)


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES")
    chosen = names.split(",") if names else HEADLINE
    spark = local_session("bench")
    times = {}
    for name in chosen:
        query = QUERIES[name]
        run = lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        run()
        times[name] = round(timed(run), 3)
    print(
        json.dumps(
            {
                "metric": "ledger_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    drop_staged(spark)
    spark.stop()


if __name__ == "__main__":
    main()
