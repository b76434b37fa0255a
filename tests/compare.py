"""Run registered queries in Spark and DuckDB and compare whole results."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


def difference(df, con, sql):
    """None when equal, else a description of the first difference."""
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    right = rows_of(columns, cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {set(left[0]) ^ set(right[0])}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows, expected {len(right[1])}"
    for mine, theirs in zip(left[1], right[1]):
        if mine != theirs or [type(v) for v in mine] != [type(v) for v in theirs]:
            bad = [(n, a, b) for n, a, b in zip(left[0], mine, theirs)
                   if a != b or type(a) is not type(b)]
            return f"first differing row {bad[:3]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from cohortide.session import build_session

    folder = sys.argv[1]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                "spark.ui.enabled": "false",
                                                "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, wanted = duck(folder), entry.oracle_sql(), sys.argv[2:]
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in oracles:
                result = difference(df, con, oracles[name]) or "equal"
            else:
                result = f"{len(df.collect())} rows"
        except Exception as error:  # keep going: this is a report
            result = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:34s} {time.time() - start:6.1f}s  {result}", flush=True)
