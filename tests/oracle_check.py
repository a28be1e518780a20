"""Side-by-side check of registered Spark queries against their DuckDB oracle SQL.

Mirrors the driver's gate: same row count, same column names and types, same
order-insensitive multiset of values. Usable from pytest and as a script:

    python tests/oracle_check.py /root/testdata/sf0.01 [name-substring ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def canon(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "T" if v else "F"
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v == v.to_integral_value() else format(v, "f").rstrip("0")
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(canon(r[i]) for i in order) for r in rows)
    return len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest()


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP",
                 "date": "DATE", "boolean": "BOOLEAN", "double": "DOUBLE"}


def type_mismatches(df, relation) -> list[str]:
    """Columns whose Spark type and DuckDB type differ (decimal precision and scale included)."""
    duck = dict(zip(relation.columns, [str(t).replace(" ", "") for t in relation.types]))
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        want = SPARK_TO_DUCK.get(t, t.upper()).replace(" ", "")
        if duck.get(f.name) != want:
            out.append(f"{f.name}: {t} vs {duck.get(f.name)}")
    return out


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def check(spark, sf_dir: str, names=None, verbose=True) -> dict[str, dict]:
    import __spark_entry__ as entry
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck_connect(sf_dir)
    results = {}
    for name, fn in qs.items():
        if names and not (name in names if isinstance(names, set) else any(n in name for n in names)):
            continue
        rec = {"oracle": name in sqls}
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
            rec["spark_rows"], rec["spark_hash"] = digest(cols, rows)
            rec["spark_sec"] = round(time.time() - t0, 2)
            if name in sqls:
                cur = con.execute(sqls[name])
                dcols = [d[0] for d in cur.description]
                drows = cur.fetchall()
                rec["oracle_rows"], rec["oracle_hash"] = digest(dcols, drows)
                rec["columns_match"] = sorted(cols) == sorted(dcols)
                rec["type_mismatches"] = type_mismatches(df, con.sql(sqls[name]))
                rec["match"] = (rec["columns_match"] and not rec["type_mismatches"]
                                and rec["spark_hash"] == rec["oracle_hash"])
                if not rec["match"]:
                    rec["spark_cols"], rec["oracle_cols"] = sorted(cols), sorted(dcols)
                    order = sorted(range(len(cols)), key=lambda i: cols[i])
                    dorder = sorted(range(len(dcols)), key=lambda i: dcols[i])
                    s_lines = sorted("|".join(canon(r[i]) for i in order) for r in rows)
                    d_lines = sorted("|".join(canon(r[i]) for i in dorder) for r in drows)
                    only_s = sorted(set(s_lines) - set(d_lines))[:3]
                    only_d = sorted(set(d_lines) - set(s_lines))[:3]
                    rec["only_spark"], rec["only_oracle"] = only_s, only_d
            else:
                rec["match"] = None
        except Exception as exc:  # report and go on
            rec["error"] = f"{type(exc).__name__}: {str(exc)[:400]}"
            rec["match"] = False
        results[name] = rec
        if verbose:
            flag = {True: "OK  ", False: "FAIL", None: "rows"}[rec["match"]]
            print(f"{flag} {name:40s} {rec.get('spark_rows')} / {rec.get('oracle_rows')} "
                  f"{rec.get('spark_sec')}s {rec.get('error', '')}", flush=True)
            if rec["match"] is False and "error" not in rec:
                for k in ("spark_cols", "oracle_cols", "only_spark", "only_oracle", "type_mismatches"):
                    print(f"      {k}: {rec.get(k)}")
    return results


if __name__ == "__main__":
    from tillbook.core import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]")
    res = check(spark, sf, sys.argv[2:] or None)
    bad = [k for k, v in res.items() if v["match"] is False]
    print(f"{len(res)} checked, {len(bad)} failing: {bad}")
