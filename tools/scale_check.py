"""Scale and skew check: run headline jobs on a 10x, skewed copy of the sf0.1 tables.

    python tools/scale_check.py <scratch-dir> [copies] [query ...]

The copy is derived with Spark from the given tables (never committed): lineitem
and orders are repeated ``copies`` times with shifted order keys, and a third of
all sale lines are moved to one hot product (7); events are repeated with a
third of them moved to one hot order / user (7). Spark's event log is written to
the scratch folder; for each job the largest task of every stage is reported as
a share of that stage's shuffle-read records, which shows whether a hot key
ended up in a single task. Prints a markdown table.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import time
from collections import defaultdict

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SOURCE = "/root/testdata/sf0.1"
DEFAULT = ["rep2_inventory_report", "rep5_inventory_export", "rep1_sales_report", "win1_current_status",
           "agg12_customer_order_stats", "chg4_fold_cart", "chg3_purchases_sales", "join7_order_lines", "rep9_receipts", "join9_deletable_products",
           "chg2_product_deletes", "chg5_checkout_orders", "agg15_order_history_nested"]


def build_copy(spark, out: str, copies: int) -> None:
    from pyspark.sql import functions as F
    if os.path.exists(os.path.join(out, "_done")):
        return
    span = 10_000_000

    def repeat(df):
        return df.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))

    li = repeat(spark.read.parquet(f"{SOURCE}/lineitem.parquet"))
    li = li.withColumn("l_orderkey", F.col("l_orderkey") + F.col("rep") * span)
    hot = (F.xxhash64("l_orderkey", "l_linenumber", "l_suppkey") % 3) == 0
    li = li.withColumn("l_partkey", F.when(hot, F.lit(7).cast("long")).otherwise(F.col("l_partkey"))).drop("rep")
    li.write.mode("overwrite").parquet(f"{out}/lineitem.parquet")
    o = repeat(spark.read.parquet(f"{SOURCE}/orders.parquet"))
    o.withColumn("o_orderkey", F.col("o_orderkey") + F.col("rep") * span).drop("rep") \
        .write.mode("overwrite").parquet(f"{out}/orders.parquet")
    ev = repeat(spark.read.parquet(f"{SOURCE}/events.parquet"))
    ev = ev.withColumn("event_id", F.col("event_id") + F.col("rep") * span)
    ev = ev.withColumn("user_id", F.when(F.xxhash64("event_id") % 3 == 0, F.lit(7).cast("long"))
                       .otherwise(F.col("user_id"))).drop("rep")
    ev.write.mode("overwrite").parquet(f"{out}/events.parquet")
    for t in ["part", "customer", "supplier", "nation", "region"]:
        spark.read.parquet(f"{SOURCE}/{t}.parquet").write.mode("overwrite").parquet(f"{out}/{t}.parquet")
    open(os.path.join(out, "_done"), "w").close()


def stage_skew(log_dir: str, job_groups: dict[str, str]) -> dict[str, tuple[int, int, float, int]]:
    """Per query: among stages that read at least 100,000 shuffle records, the one whose largest
    task read the biggest share: (its records, the records of that task, the share, task count).
    Partial aggregation keeps most stages far below that size."""
    files = [f for f in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(f)]
    per_stage = defaultdict(list)
    stage_group = {}
    for path in files:
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    rec = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    per_stage[ev["Stage ID"]].append(rec)
    out = {}
    for name, group in job_groups.items():
        worst = (0, 0, 0.0, 0)
        for sid, recs in per_stage.items():
            if stage_group.get(sid) != group or sum(recs) < 100_000:
                continue
            share = max(recs) / sum(recs)
            if share > worst[2]:
                worst = (sum(recs), max(recs), share, len(recs))
        out[name] = worst
    return out


def main() -> None:
    scratch = sys.argv[1]
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    names = sys.argv[3:] or DEFAULT
    log_dir = os.path.join(scratch, "eventlog")
    os.makedirs(log_dir, exist_ok=True)
    from tillbook.core import build_session
    from tillbook.registry import QUERIES
    # 32 shuffle partitions and no coalescing, so task shares show how keys spread (1/32 is even); no forced skew splits
    spark = build_session("local[8]", 32, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                                 "spark.sql.adaptive.coalescePartitions.enabled": "false",
                                                 "spark.sql.adaptive.forceOptimizeSkewedJoin": "false",
                                                 # a hot partition has some 20 MB here, not the 256 MB from which Spark calls it skewed
                                                 "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2m",
                                                 "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
                                                 # dimension tables are not small enough to broadcast at scale
                                                 "spark.sql.autoBroadcastJoinThreshold": "-1",
                                                "spark.eventLog.rolling.enabled": "false",
                                                "spark.eventLog.compress": "false", "spark.driver.memory": "16g"})
    data = os.path.join(scratch, f"x{copies}")
    build_copy(spark, data, copies)
    rows = []
    groups = {}
    QUERIES["rep5_inventory_export"](spark, SOURCE).write.format("noop").mode("overwrite").save()  # warm-up
    for name in names:
        for sf, label in [(SOURCE, "sf0.1"), (data, f"x{copies} skewed")]:
            group = f"{name}-{label}"
            groups[group] = group
            spark.sparkContext.setJobGroup(group, group)
            t0 = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            rows.append((name, label, round(time.perf_counter() - t0, 2), group))
    spark.sparkContext.setJobGroup("done", "done")
    spark.stop()
    skew = stage_skew(log_dir, groups)
    print("| Query | Data | Seconds | Worst stage of >= 100k shuffle rows: rows, largest task, share, tasks |")
    print("| --- | --- | --- | --- |")
    for name, label, sec, group in rows:
        total, top, share, tasks = skew.get(group, (0, 0, 0.0, 0))
        cell = f"{total:,} / {top:,} / {share:.1%} / {tasks}" if total else "no stage that large"
        print(f"| `{name}` | {label} | {sec} | {cell} |")


if __name__ == "__main__":
    main()
