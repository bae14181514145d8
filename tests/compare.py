"""Run registered queries against their SQL twins in DuckDB and report differences.

    python tests/compare.py [--sf DIR] [name-part ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT",
         "boolean": "BOOLEAN", "tinyint": "TINYINT"}


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0) if v else "0.0"
    if isinstance(v, (decimal.Decimal, datetime.datetime)):
        return str(v)
    return repr(v)


def diff(spark_df, con, sql: str) -> str | None:
    """None when rows, column names, types and values agree."""
    rel = con.execute(sql)
    theirs_cols = [d[0] for d in rel.description]
    theirs_types = {d[0]: str(d[1]) for d in rel.description}
    theirs = rel.fetchall()
    ours = spark_df.collect()
    cols = sorted(spark_df.columns)
    if cols != sorted(theirs_cols):
        return f"columns {cols} != {sorted(theirs_cols)}"
    types = dict(spark_df.dtypes)
    bad = [c for c in cols if TYPES.get(types[c], types[c]) != theirs_types[c]]
    if bad:
        return f"types {[(c, types[c], theirs_types[c]) for c in bad]}"
    place = {c: i for i, c in enumerate(theirs_cols)}
    a = sorted(tuple(cell(r[c]) for c in cols) for r in ours)
    b = sorted(tuple(cell(r[place[c]]) for c in cols) for r in theirs)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"values of {cols}: spark only {only_a} sql only {only_b}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from flowlens.session import session

    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    spark = session("compare", cores=int(os.environ.get("BENCH_CPUS", "8")))
    con = duck(sf_dir)
    sqls = entry.oracle_sql()
    failed = 0
    for name, build in entry.queries().items():
        if argv and not any(a in name for a in argv):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in sqls:
                problem = diff(df, con, sqls[name])
                n = ""
            else:
                problem, n = None, f" rows-only {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s{n}"
              + (f"\n     {problem[:1500]}" if problem else ""), flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
