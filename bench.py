"""Time every headline query and print one JSON line.

``BENCH_SF_DIR`` names the input folder, ``BENCH_CPUS`` the local cores. Layer jobs run from
bronze to stored gold; dashboard queries read the stored gold tables, which are built (and
timed as ``layer_all``) first. Each figure is the median of three runs after one warm-up.
"""

import json
import os
import statistics
import time

from fixtures.registry import QUERIES
from viewmart.session import local_session

HEADLINE = [
    "layer_all", "silver_customers", "silver_tickets", "silver_logs", "gold_billing", "gold_operations", "gold_content",
    "customer_ticket_metrics", "technician_scores", "content_agg", "popularity_tier", "sla_compliance",
    "d1_revenue_by_region", "d1_health_hist", "d1_segment_revenue", "d2_kpis", "d2_reach_top", "d2_top_viewed",
    "d3_kpis", "d3_department_perf", "exec_overview", "exec_risk", "layer_reconciliation", "dq_null_rates",
    "dq_duplicate_customers", "dq_orphans",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    seconds = {}
    for name in HEADLINE:
        run(spark, name, folder)
        seconds[name] = round(statistics.median(run(spark, name, folder) for _ in range(repeats)), 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
