"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (cores), BENCH_QUERIES (names, all if unset).  Every query runs
its whole plan over the whole tables; results go to Spark's `noop` sink.  A first
pass on the same data warms the JVM; the reported time is the better of two more.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from auditlens.plans.queries import QUERIES  # noqa: E402
from auditlens.session import build_session  # noqa: E402

HEADLINE = {
    "verdicts_by_role": "conversations",
    "b3_check_injection": "conversations",
    "a4_scan_code_table": "documents",
    "g2_project_scan_merged": "documents",
    "g3_project_scan_rollup": "documents",
    "g4_project_files": "documents",
    "g6_compliance_report": "documents",
    "l2_article_sort": "documents",
    "b1_detect_framework": "documents",
    "b5_classify_risk": "events",
    "j2_remediation_join": "documents",
    "j5_agents_with_stats": "events",
    "g7_agent_stats": "events",
    "w1_verify_chain": "events",
    "w3_build_chain": "events",
    "w4_agent_status": "events",
    "x5_history_trend": "orders",
    "x1_gdpr_rules": "documents",
}


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("auditlens-bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    rates: dict[str, int] = {}
    text_rates: dict[str, float] = {}
    wanted = os.environ.get("BENCH_QUERIES", "").split()
    for name, source in ((n, s) for n, s in HEADLINE.items() if not wanted or n in wanted):
        timed(spark, name, folder)
        seconds[name] = round(min(timed(spark, name, folder) for _ in range(2)), 3)
        table = spark.read.parquet(f"{folder}/{source}.parquet")
        rates[name] = int(table.count() / seconds[name])
        if "text" in table.columns:
            size = table.agg(F.sum(F.octet_length("text"))).first()[0] / 1e6
            text_rates[name] = round(size / seconds[name] / int(cores), 2)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rates,
                "text_mb_per_sec_core": text_rates,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
