"""Run a registered query and its SQL on the same folder and compare all rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from faultspark.plans.registry import TABLES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return f"f:{v!r}" if not (v == 0 and math.copysign(1, v) < 0) else "f:-0.0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if hasattr(v, "item"):
        return _cell(v.item())
    if isinstance(v, int):
        return f"i:{v}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def check(spark, con, q, folder):
    from faultspark.plans.registry import Tables

    t0 = time.time()
    df = q.build(Tables(spark, folder))
    got = [tuple(r) for r in df.collect()]
    sec = time.time() - t0
    if q.sql is None:
        return len(got), sec, None if got else "no rows"
    rel = con.execute(q.sql)
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(cols) != sorted(df.columns):
        return len(got), sec, f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = rows(df.columns, got), rows(cols, want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return len(got), sec, f"rows {len(a)} vs {len(b)}; cols {sorted(cols)}; first differences {diff}"
    return len(got), sec, None if got else "no rows"


def session(**conf):
    from pyspark.sql import SparkSession

    b = SparkSession.builder.master("local[8]").appName("faultspark-check")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def main():
    """python -m tests.compare <sf dir> [name or code prefix ...]"""
    from faultspark.plans import load_all

    registry = load_all()
    folder, wanted = sys.argv[1], sys.argv[2:]
    conf = {}
    if "--small-chunks" in wanted:
        wanted.remove("--small-chunks")
        conf = {"faultspark.chunkBytes": "3000", "faultspark.seriesChunk": "16"}
    spark, con = session(**conf), connect(folder)
    bad = 0
    for q in registry.values():
        if wanted and not any(q.name == w or q.code == w or (w.endswith("*") and q.code.startswith(w[:-1])) for w in wanted):
            continue
        try:
            n, sec, err = check(spark, con, q, folder)
        except Exception as e:  # noqa: BLE001
            n, sec, err = -1, 0, f"{type(e).__name__}: {str(e)[:900]}"
        bad += err is not None
        print(f"{'FAIL' if err else 'ok  '} {q.code:4} {q.name:34} {n:7} {sec:6.2f}s {'sql' if q.sql else '-'} {err or ''}", flush=True)
    print("failures", bad)


if __name__ == "__main__":
    main()
