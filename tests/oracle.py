"""Runs registered queries beside their SQL in DuckDB and compares the rows.

    python -m tests.oracle [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def connect(sf: str = SF):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v != int(v) else str(int(v))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, fn, sql: str, sf: str = SF) -> str:
    """"" when both sides agree, else what differs."""
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    odd = {c: t for c, t in types.items() if any(x in t.upper() for x in ("HUGEINT", "DECIMAL", "[]", "STRUCT", "MAP"))}
    if odd:
        return f"awkward SQL types {odd}"
    odd = {f.name: f.dataType.simpleString() for f in df.schema if f.dataType.simpleString().startswith(
        ("array", "map", "struct", "decimal", "float", "variant"))}
    if odd:
        return f"awkward Spark types {odd}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return "" if a else "both empty"
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return (f"rows {len(a)} vs {len(b)}; columns {sorted(cols)}\n      spark only {str(only_a)[:900]}"
            f"\n      sql only   {str(only_b)[:900]}")


def main(prefixes: list[str]) -> int:
    import __spark_entry__ as entry
    from folioscope.session import local_session
    spark = local_session(8)
    con = connect()
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        began = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, name, fn, sqls[name])
            else:
                df = fn(spark, SF)
                n = len(df.collect())
                problem = "" if n else "no rows"
        except Exception as e:  # noqa: BLE001 - a failing query is reported with the others
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - began:.1f}s"
              f"{'' if name in sqls else ' (rows only)'} {problem}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
