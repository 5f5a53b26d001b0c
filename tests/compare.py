"""Run registered queries beside their SQL in DuckDB: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        out = []
        for v in row:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                out.append("~")
            elif isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
                out.append(str(bool(v)))
            elif isinstance(v, (int, float)) or hasattr(v, "dtype"):
                out.append(f"{float(v):.6f}".replace("-0.000000", "0.000000"))
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def compare(spark, con, name: str, fn, sql: str | None, sf: str) -> str:
    start = time.time()
    mine = fn(spark, sf)
    got = mine.toPandas()
    took = time.time() - start
    if sql is None:
        return f"rows {name}: {len(got)} rows {list(got.columns)} {took:.1f}s"
    start = time.time()
    want = con.execute(sql).df()
    note = f"{len(got)}/{len(want)} rows {took:.1f}s (sql {time.time() - start:.1f}s)"
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL {name}: columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"FAIL {name}: {note} {sorted(got.columns)} first differences {diff}"
    kinds = con.execute(f"DESCRIBE {sql}").df().set_index("column_name")["column_type"].to_dict()
    spark_kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {c: (k, kinds[c]) for c, k in mine.dtypes if spark_kinds.get(k) != kinds[c]}
    return f"ok   {name}: {note}" + (f"  TYPES {odd}" if odd else "") + ("  EMPTY" if not len(got) else "")


def main() -> None:
    from donorlake.session import build_session
    from __spark_entry__ import oracle_sql, queries

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(sf), oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if args and not any(a == name or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        try:
            line = compare(spark, con, name, fn, sql.get(name), sf)
        except Exception as error:  # noqa: BLE001
            line = f"FAIL {name}: {type(error).__name__} {str(error)[:700]}"
        bad += line.startswith("FAIL")
        print(line, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
