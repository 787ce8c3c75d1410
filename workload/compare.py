"""Run registered queries in Spark and DuckDB and compare them.

``python -m workload.compare [sf_dir] [name ...]``
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

from workload.catalog import QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str) -> dict:
    run, sql = QUERIES[name]
    start = time.time()
    df = run(spark, sf_dir)
    got = df.collect()
    out = {"rows": len(got), "spark": round(time.time() - start, 2), "ok": True, "note": ""}
    if not sql:
        return out | {"note": "no SQL"}
    start = time.time()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]).lower() for d in result.description}
    want = result.fetchall()
    out["duckdb"] = round(time.time() - start, 2)
    if sorted(columns) != sorted(df.columns):
        return out | {"ok": False, "note": f"columns {sorted(df.columns)} / {sorted(columns)}"}
    odd = [f"{f.name} {f.dataType.simpleString()} / {kinds[f.name]}" for f in df.schema
           if _kind(f.dataType.simpleString()) != _kind(kinds[f.name])]
    a, b = _bag(df.columns, got), _bag(columns, want)
    if a != b:
        return out | {"ok": False, "note": f"{len(got)} / {len(want)} rows; only Spark "
                      f"{str(list((a - b).items())[:1])[:600]}; only DuckDB "
                      f"{str(list((b - a).items())[:1])[:600]}"}
    if odd:
        return out | {"ok": False, "note": f"types {odd}"}
    return out


def _kind(name: str) -> str:
    return {"integer": "int", "varchar": "string", "number": "double"}.get(name, name)


def main() -> None:
    from passagework.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        try:
            found = compare(spark, con, sf_dir, name)
        except Exception as error:
            found = {"ok": False, "note": f"{type(error).__name__}: {str(error)[:1500]}"}
        bad += not found["ok"]
        print("ok " if found["ok"] else "BAD", name,
              {k: v for k, v in found.items() if k not in ("ok", "note")}, found["note"],
              flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
