"""Write PLANS.md: the final (adaptive) physical plan of each registered query, summarised.

    python tools/plan_summary.py [/root/testdata/sf0.1]

For every query that builds lazily, the plan is executed once (no-op sink) and
the final adaptive plan is scanned for join strategies, exchanges, aggregate
kinds and, per parquet scan, the pushed filters and the columns read.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

EAGER = ("chg1", "chg2", "chg3", "chg5", "chg6", "chg7", "chg8", "chg9", "join10", "join11", "str", "snk", "srt",
         "src1_read_table")
OPS = ["BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
       "HashAggregate", "SortAggregate", "ObjectHashAggregate", "Window", "TakeOrderedAndProject", "Expand"]


def final_plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    if "== Final Plan ==" in text:
        text = text.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    return text


def summarise(text: str) -> dict:
    ops = Counter()
    for op in OPS:
        ops[op] = len(re.findall(rf"\b{op}\b", text))
    exchanges = Counter(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)", text))
    scans = []
    for m in re.finditer(r"FileScan parquet \[[^\]]*\][^\n]*?PushedFilters: \[([^\]]*)\], ReadSchema: (struct<[^\n]*?>)"
                         r"|FileScan parquet \[[^\]]*\][^\n]*", text):
        line = m.group(0)
        table = re.search(r"/([a-z_]+)\.parquet", line)
        pushed = re.search(r"PushedFilters: \[([^\]]*)\]", line)
        schema = re.search(r"ReadSchema: struct<([^\n]*?)>", line)
        scans.append((table.group(1) if table else "?", pushed.group(1) if pushed else "",
                      len(schema.group(1).split(",")) if schema else 0))
    return {"ops": {k: v for k, v in ops.items() if v}, "exchanges": dict(exchanges), "scans": scans}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from tillbook.core import build_session
    from tillbook.registry import QUERIES
    spark = build_session("local[8]", extra={"spark.sql.maxMetadataStringLength": "2000"})
    lines = ["# Final physical plans of the registered queries",
             "",
             f"Generated by `tools/plan_summary.py` on `{sf}`, `local[8]`, AQE on. Counts are operators in the",
             "final adaptive plan; scans list the table, the filters pushed into the parquet reader and the",
             "number of columns read. Jobs that write while they are built (change jobs, sinks, streams, sorted",
             "positions) are left out here; their plans are checked in `tests/`.",
             "",
             "| Query | Joins / aggregates | Exchanges | Scans (table: pushed filters; columns read) |",
             "| --- | --- | --- | --- |"]
    for name in sorted(QUERIES):
        if name.startswith(EAGER):
            continue
        df = QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        s = summarise(final_plan(df))
        ops = ", ".join(f"{k} {v}" for k, v in s["ops"].items()) or "-"
        exch = ", ".join(f"{k} {v}" for k, v in s["exchanges"].items()) or "none"
        scans = "; ".join(f"{t}: {p or 'none'}; {c} cols" for t, p, c in s["scans"])
        lines.append(f"| `{name}` | {ops} | {exch} | {scans} |")
    with open(os.path.join(ROOT, "PLANS.md"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
