"""Run registered queries in Spark and their check SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float, Decimal)):
        f = float(v)
        return (2, "nan" if math.isnan(f) else f"{f + 0.0:.9g}")
    if isinstance(v, (list, tuple)):
        return (3, str([_norm(x) for x in v]))
    return (4, str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(_norm(r[i]) for i in order) for r in rows]), [cols[i] for i in order]


def compare(spark, con, sf_dir, name, fn, sql):
    """None when equal, else a short description; second value is the Spark time."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return (None if got else "no rows"), took, len(got)
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want, wc = rows_of(want_cols, cur.fetchall())
    have, hc = rows_of(df.columns, got)
    if wc != hc:
        return f"columns {hc} != {wc}", took, len(got)
    if want != have:
        w, h = set(want), set(have)
        return (
            f"rows {len(have)} vs {len(want)}; only spark {[list(zip(hc, r)) for r in sorted(h - w)[:2]]}; "
            f"only sql {[list(zip(hc, r)) for r in sorted(w - h)[:2]]}"
        ), took, len(got)
    return None, took, len(got)


def types_differ(df, con, sql):
    """Column types that are not the same kind in both engines."""
    kinds = {"bigint": "int", "int": "int", "double": "float", "string": "text", "boolean": "bool"}
    duck = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "HUGEINT": "hugeint"}
    rel = con.execute(f"DESCRIBE {sql}").fetchall()
    want = {r[0]: duck.get(str(r[1]), str(r[1])) for r in rel}
    return {c: (t, want.get(c)) for c, t in df.dtypes if want.get(c) != t and kinds.get(t, t) != want.get(c)}


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    import logging

    logging.getLogger("SQLQueryContextLogger").setLevel(logging.CRITICAL)
    con = connect(sf)
    qs, os_ = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            msg, took, n = compare(spark, con, sf, name, fn, os_.get(name))
            if msg is None and name in os_:
                diff = types_differ(fn(spark, sf), con, os_[name])
                extra = f" types {diff}" if diff else ""
            else:
                extra = ""
        except Exception as e:  # noqa: BLE001
            msg, took, n, extra = f"{type(e).__name__}: {str(e)[:600]}", 0.0, 0, ""
        bad += msg is not None
        print(f"{'OK ' if msg is None else 'BAD'} {name} rows={n} {took:.1f}s{extra} {msg or ''}", flush=True)
    print("bad:", bad)
