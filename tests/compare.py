"""Run registered queries against their SQL text in DuckDB: `python -m tests.compare [folder] [prefix ...]`."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def rows_of(names, rows):
    """Rows as sorted tuples in column-name order."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(norm(x) for x in v) + "]"
        return repr(v)
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def duck(folder):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp": "TIMESTAMP", "date": "DATE", "smallint": "SMALLINT"}


def compare(spark, con, folder, call, sql):
    """None when equal, else what differs."""
    df = call(spark, folder)
    got = df.collect()
    if sql is None:
        return None, len(got)
    rel = con.execute(sql)
    want_names = [d[0] for d in rel.description]
    want_types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} != {sorted(want_names)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    a, b = rows_of(df.columns, got), rows_of(want_names, want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"{len(diff)} rows differ\n   spark {only_a}\n   duck  {only_b}", len(got)
    for name, kind in df.dtypes:
        if kind in KINDS and want_types[name] != KINDS[kind]:
            return f"type of {name}: {kind} != {want_types[name]}", len(got)
    return None, len(got)


def main():
    from pyspark.sql import SparkSession
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    oracle = entry.oracle_sql()
    bad = 0
    for name, call in entry.queries().items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, folder, call, oracle.get(name))
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={n} {time.time() - start:.1f}s"
              f"{'' if name in oracle else ' (rows only)'}{'' if problem is None else ' ' + problem}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
