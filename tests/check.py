"""Runs queries on Spark and their oracle SQL on DuckDB and compares the rows.

    python tests/check.py [sf] [name ...]
"""
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ROOT = os.environ.get("TESTDATA", "/root/testdata")


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def canon(rows):
    return sorted([tuple(cell(c) for c in r) for r in rows], key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    left = [tuple(r[c] for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    took = time.time() - t
    if sql is None:
        return len(left), took, "no oracle"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return len(left), took, f"columns differ: {cols} vs {sorted(names)}"
    idx = [names.index(c) for c in cols]
    right = [tuple(r[i] for i in idx) for r in cur.fetchall()]
    a, b = canon(left), canon(right)
    if a == b:
        return len(left), took, "ok"
    only_a = [x for x in a if x not in set(b)][:3] if len(a) < 200000 else []
    only_b = [x for x in b if x not in set(a)][:3] if len(a) < 200000 else []
    return len(left), took, f"DIFF spark={len(a)} duck={len(b)}\n   cols={cols}\n   spark only {str(only_a)[:700]}\n   duck only  {str(only_b)[:700]}"


def main():
    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"{ROOT}/sf{sf}"
    want = sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    qs, os_ = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if want and not any(name.startswith(w) for w in want):
            continue
        try:
            n, took, res = compare(spark, con, name, fn, os_.get(name), sf_dir)
        except Exception as exc:  # report every query, not only the first failure
            n, took, res = -1, 0.0, f"ERROR {type(exc).__name__}: {str(exc)[:300]}"
        if res not in ("ok", "no oracle"):
            bad += 1
        print(f"{'ok ' if res == 'ok' else '-- ' if res == 'no oracle' else 'BAD'} {name:40s} rows={n:7d} {took:6.2f}s {'' if res == 'ok' else res}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
