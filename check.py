"""Compare registered queries with their SQL in DuckDB: python check.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from boxloom.plans import REGISTRY
from boxloom.plans.inputs import TABLES


def make_session(cores: str = "8") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("boxloom")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


KINDS = {"BIGINT": "long", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
         "TIMESTAMP": "timestamp"}


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, folder: str) -> str:
    entry = REGISTRY[name]
    start = time.time()
    df = entry.run(spark, folder)
    fields = {f.name: f.dataType.typeName() for f in df.schema.fields}
    cols = sorted(fields)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    took = time.time() - start
    if entry.sql is None:
        return f"rows-only {len(got)} rows {took:.1f}s"
    start = time.time()
    cur = con.execute(entry.sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    rows = cur.fetchall()
    duck = time.time() - start
    if sorted(names) != cols:
        return f"FAIL columns spark={cols} sql={sorted(names)}"
    bad_types = {c: (fields[c], kinds[c]) for c in cols if KINDS.get(kinds[c], kinds[c]) != fields[c]}
    order = [names.index(c) for c in cols]
    want = sorted(tuple(cell(r[i]) for i in order) for r in rows)
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return (f"FAIL rows spark={len(got)} sql={len(want)} cols={cols}\n  only spark: {sorted(a)[:3]}"
                f"\n  only sql:   {sorted(b)[:3]}")
    note = f" TYPES {bad_types}" if bad_types else ""
    return f"ok {len(got)} rows spark {took:.1f}s sql {duck:.1f}s{note}{' EMPTY' if not got else ''}"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark, con = make_session(), open_tables(folder)
    failed = 0
    for name in names:
        try:
            text = compare(spark, con, name, folder)
        except Exception as exc:  # report and go on with the next query
            text = f"FAIL {type(exc).__name__}: {str(exc)[:900]}"
        failed += text.startswith("FAIL")
        print(f"{name}: {text}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
