"""Run registered queries in Spark and their SQL in DuckDB, and compare rows.

    python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from qamill.plans.fixtures import TABLES


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    """(matches, message)"""
    t0 = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return False, f"{name}: {len(got)} rows, no SQL to compare with, {t1 - t0:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    t2 = time.time()
    if sorted(names) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} vs {sorted(names)}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
        text = "\n   ".join(f"spark {a!r:.900}\n   duck  {b!r:.900}" for a, b in diff)
        return False, f"{name}: {len(got)} vs {len(want)} rows\n   {text}"
    return True, f"{name}: {len(got)} rows ok, spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"


def main(argv):
    import __spark_entry__ as entry
    from qamill.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    only = argv[1:]
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                                   "spark.driver.memory": "12g", "spark.ui.enabled": "false",
                                   "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for name, query in queries.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            ok, message = compare(spark, con, sf_dir, name, query, sqls.get(name))
        except Exception as error:  # report and go on
            ok, message = False, f"{name}: {type(error).__name__} {str(error)[:1500]}"
        print(("ok   " if ok else "FAIL ") + message, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}; {len(queries)} queries, {len(sqls)} oracles")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
