"""Compare registered queries with their SQL on DuckDB: names, row count and values, order left out."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        if isinstance(v, int) and abs(v) > 2**53:
            return str(v)  # a double would hide the last digits
        v = float(v)
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return str(sorted((k, cell(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, fn, sql):
    """None when equal, else a description of the difference."""
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}: {got[1][:3]} / {want[1][:3]}"
    diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(diff)} rows differ: {diff[:3]}" if diff else None


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e
    from sparkprep.session import get_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                              "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sqls = e.queries(), e.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in sqls:
                said = compare(spark, con, folder, fn, sqls[name])
            else:
                n = fn(spark, folder).count()
                said = None if n > 0 else "no rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:600]}"
        bad += said is not None
        print(f"{'ok ' if said is None else 'BAD'} {time.time() - t:6.2f}s {name} {'' if name in sqls else '(rows)'} {said or ''}", flush=True)
    print("bad:", bad)
