"""Run registered queries next to their SQL twins: ``python tests/oracle.py [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from evenkeel.suite.registry import NAMES, Tables, load_all  # noqa: E402

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{folder}/{n}.parquet')")
    return con


SQL_TIME: dict[str, float] = {}


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def rows_of(cols: list[str], rows) -> list[str]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("\x1f".join(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    q = load_all()[name]
    df = q.build(Tables(spark, folder))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if not q.sql:
        return bool(got), f"rows only: {len(got)}"
    mid = time.time()
    cur = con.execute(q.sql)
    cols = [c[0] for c in cur.description]
    want = rows_of(cols, cur.fetchall())
    SQL_TIME[name] = time.time() - mid
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got != want:
        extra, missing = set(got) - set(want), set(want) - set(got)
        show = lambda s: [x.replace("\x1f", " | ")[:300] for x in sorted(s)[:3]]
        return False, f"{len(got)} vs {len(want)} rows\n   cols {sorted(cols)}\n   spark only {len(extra)} {show(extra)}\n   sql only {len(missing)} {show(missing)}"
    kinds = {c[0]: str(c[1]) for c in cur.description}
    return True, f"{len(got)} rows" + ("" if got else " EMPTY") + (
        f" HUGEINT in {[k for k, v in kinds.items() if 'HUGE' in v]}" if any("HUGE" in v for v in kinds.values()) else "")


def main(names: list[str]) -> int:
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in (kv.split("=", 1) for kv in os.environ.get("CONF", "").split(",") if kv):
        spark.conf.set(k, v)
    con = connect(SF_DIR)
    bad = 0
    for name in names or list(load_all()):
        t0 = time.time()
        try:
            ok, note = compare(spark, con, name, SF_DIR)
        except Exception as e:  # noqa: BLE001
            ok, note = False, "".join(traceback.format_exception_only(e))[:1500]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0 - SQL_TIME.get(name, 0):.1f}s (sql {SQL_TIME.get(name, 0):.1f}s) {note}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
