"""Compare registered queries with their SQL twins: ``python tests/oracle.py [prefix ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    cols = []
    for c in pdf.columns:
        s = pdf[c]
        if pd.api.types.is_datetime64_any_dtype(s):
            s = s.astype(str)
        cols.append([None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA or v == "NaT" else v for v in s.tolist()])
    rows = [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in zip(*cols)]
    return sorted(rows, key=repr)


def compare(spark, con, name: str, sf_dir: str = SF_DIR) -> str:
    """'' when equal, else what differs."""
    got = entry.queries()[name](spark, sf_dir)
    types = dict(got.dtypes)
    bad = [t for t in types.values() if t.startswith(("array", "struct", "map", "decimal"))]
    gp = got.toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "" if len(gp) else "no rows"
    want = con.sql(sql).to_arrow_table()
    wt = {f.name: str(f.type) for f in want.schema}
    kinds = {"bigint": "int64", "int": "int32", "string": "string", "double": "double", "boolean": "bool", "timestamp_ntz": "timestamp[us]"}
    if set(wt) != set(types):
        return f"columns {sorted(types)} vs {sorted(wt)}"
    off = {c: (t, wt[c]) for c, t in types.items() if kinds.get(t, t) != wt[c]}
    a, b = _norm(gp), _norm(want.to_pandas())
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)} {[x for x in a if x not in b][:3]} {[x for x in b if x not in a][:3]}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)} of {len(a)} rows differ: {diff[:3]} cols {sorted(types)}"
    if not a:
        return "no rows"
    if bad:
        return f"nested columns {bad}"
    if off:
        return f"types {off}"
    return ""


def main() -> int:
    from kerbline.session import build_session

    spark = build_session("oracle", "local[4]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck()
    want = sys.argv[1:]
    failed = 0
    for name in sorted(entry.queries()):
        if want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            why = compare(spark, con, name)
        except Exception as e:  # report and go on
            why = f"{type(e).__name__} {str(e)[:900]}"
        kind = "O" if name in entry.oracle_sql() else "R"
        print(f"{'ok  ' if not why else 'FAIL'} {kind} {name} {time.time() - t:.1f}s {why}", flush=True)
        failed += bool(why)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
