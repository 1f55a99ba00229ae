"""Run registered queries against their SQL text: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else v
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in v.items())
    return v


def rows_of(arrow):
    names = sorted(arrow.column_names)
    cols = [arrow.column(n).to_pylist() for n in names]
    return names, [tuple(norm(v) for v in r) for r in zip(*cols)]


def family(t) -> str:
    import pyarrow.types as pt
    if pt.is_integer(t):
        return "int"
    if pt.is_floating(t):
        return "float"
    if pt.is_decimal(t):
        return "decimal"
    if pt.is_string(t) or pt.is_large_string(t):
        return "string"
    if pt.is_timestamp(t):
        return "timestamp"
    return str(t)


def check(spark, con, name, fn, sql, sf):
    """(ok, message)"""
    start = time.time()
    got = fn(spark, sf).toArrow()
    took = time.time() - start
    if sql is None:
        return True, f"rows-only {got.num_rows} rows {took:.2f}s"
    start = time.time()
    want = con.sql(sql).to_arrow_table()
    sql_took = time.time() - start
    gn, gr = rows_of(got)
    wn, wr = rows_of(want)
    if gn != wn:
        return False, f"columns differ: spark-only {set(gn) - set(wn)}, sql-only {set(wn) - set(gn)}"
    types = [(n, family(got.schema.field(n).type), family(want.schema.field(n).type)) for n in gn]
    odd = [t for t in types if t[1] != t[2]]
    a, b = Counter(gr), Counter(wr)
    if a != b:
        left, right = list((a - b).elements()), list((b - a).elements())
        left.sort(key=repr)
        right.sort(key=repr)
        return False, (f"{len(left)} of {len(gr)} spark rows, {len(right)} of {len(wr)} sql rows unmatched {odd}\n"
                       f"   cols  {gn}\n   spark {left[:2]}\n   sql   {right[:2]}")
    return not odd, f"{len(gr)} rows spark {took:.2f}s sql {sql_took:.2f}s {odd or ''}"


def main(argv):
    import __spark_entry__ as entry
    from antecede.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8)
    con = connect(sf)
    sqls = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        try:
            ok, message = check(spark, con, name, fn, sqls.get(name), sf)
        except Exception as error:  # report every query, then fail
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("ok  " if ok else "FAIL", name, message, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
