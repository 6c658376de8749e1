"""Compare registered queries with their SQL; also usable as a script: names or prefixes as arguments."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessella.plans.fixtures import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return ("", None)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("n", float(v))
    if isinstance(v, float):
        return ("n", "nan") if math.isnan(v) else ("n", round(v, 6) + 0.0)
    if hasattr(v, "as_tuple"):
        return ("n", float(v))
    return ("s", str(v))


def rows_of(names: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str):
    """None if equal, else a short account of the difference."""
    df = fn(spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} / {want_names}"
    if got != want:
        have, need = set(got), set(want)
        a, b = list(have - need)[:3], list(need - have)[:3]
        return f"{len(got)} / {len(want)} rows; only here {a}; only there {b}"
    if not got:
        return "both empty"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tessella.runtime import build_session

    from pyspark import SparkContext

    SparkContext.setSystemProperty("spark.ui.showConsoleProgress", "false")
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = connect(sf_dir)
    picks = sys.argv[1:]
    oracle, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        t = time.time()
        try:
            if name in oracle:
                note = compare(spark, con, fn, oracle[name], sf_dir) or "ok"
            else:
                note = f"rows {fn(spark, sf_dir).count()}"
        except Exception as e:  # report and go on
            note = "FAIL " + str(e).split("JVM stacktrace")[0][:1500]
        bad += not (note == "ok" or note.startswith("rows"))
        print(f"{name:36s} {time.time() - t:6.1f}s {note}", flush=True)
    print("bad", bad)
