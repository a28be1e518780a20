"""Benchmark of the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``: one warm-up, then the median of ``$BENCH_RUNS`` (default 5) timed runs.
A run forces the whole plan through Spark's no-op sink (nothing is collected).
The same queries' DuckDB oracle SQL is timed alongside as context (the reference
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "rep1_sales_report",
    "rep2_inventory_report",
    "rep3_user_activity_report",
    "rep5_inventory_export",
    "rep6_user_activity_export",
    "agg5_daily_sales",
    "agg8_sales_kpis",
    "top1_top_products",
    "win1_current_status",
    "agg12_customer_order_stats",
    "rep9_receipts",
    "chg4_fold_cart",
    "chg5_checkout_orders",
    "chg3_purchases_sales",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    names = only or HEADLINE

    from tillbook.core import build_session
    from tillbook.oracle_sql import ORACLE
    from tillbook.registry import QUERIES

    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})

    def run_spark(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    timings: dict[str, float] = {}
    for name in names:
        run_spark(name)
        timings[name] = round(statistics.median(run_spark(name) for _ in range(runs)), 3)

    duck: dict[str, float] = {}
    try:
        sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "tests"))
        from oracle_check import duck_connect
        con = duck_connect(sf_dir)
        for name in names:
            if name not in ORACLE:
                continue
            con.execute(ORACLE[name]).fetchall()
            samples = []
            for _ in range(runs):
                t0 = time.perf_counter()
                con.execute(ORACLE[name]).fetchall()
                samples.append(time.perf_counter() - t0)
            duck[name] = round(statistics.median(samples), 3)
    except Exception as exc:  # the context timings are optional
        duck = {"error": str(exc)[:200]}

    def effective(key: str):
        try:
            return spark.conf.get(key)
        except Exception:  # not set and no default
            return None

    conf = {k: effective(k) for k in ["spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled",
                                      "spark.sql.adaptive.skewJoin.enabled",
                                      "spark.sql.autoBroadcastJoinThreshold", "spark.driver.memory"]}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf, "cpus": cpus, "runs": runs,
                      "duckdb_oracle_sec": duck, "spark_conf": conf}))
    spark.stop()


if __name__ == "__main__":
    main()
