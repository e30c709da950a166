"""Compare registered queries with their SQL: python tests/oracle.py [sf_dir] [name prefix ...]."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in data), key=repr), sorted(names)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        g = f"{p}/*.parquet" if os.path.isdir(p) else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{g}')")
    return con


def compare(spark, con, name, f, sql, sf_dir) -> str:
    """'' if the results agree, else what differs."""
    df = f(spark, sf_dir)
    a, an = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b, bn = rows([x[0] for x in cur.description], cur.fetchall())
    if an != bn:
        return f"columns {an} / {bn}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}: {[x for x in a if x not in b][:2]} / {[x for x in b if x not in a][:2]}"
    for x, y in zip(a, b):
        if x != y:
            return f"values {x} / {y}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as e
    from weftgraph.session import get_session

    sf, want = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"), sys.argv[2:]
    spark = get_session(master="local[8]", partitions=8, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    con, sql, bad = connect(sf), e.oracle_sql(), 0
    for name, f in e.queries().items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            if name in sql:
                why = compare(spark, con, name, f, sql[name], sf)
                n = "ok" if not why else why[:600]
            else:
                why, n = "", f"rows only: {f(spark, sf).count()}"
        except Exception as x:
            why = n = f"ERROR {str(x)[:900]}"
        bad += bool(why)
        print(f"{name:32s} {time.time() - t:6.1f}s {n}"[:700].replace("\n", " "), flush=True)
    print("bad:", bad)
