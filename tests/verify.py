"""Compare queries with their SQL: python tests/verify.py SCALE_DIR [NAME...]"""

from __future__ import annotations

import hashlib
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def value(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else (int(x) if x == int(x) else round(x, 9)) if math.isfinite(x) else str(x)
    if isinstance(x, (list, tuple)):
        return tuple(value(y) for y in x)
    if isinstance(x, bool):
        return int(x)
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if type(x).__name__ == "Decimal":
        return value(float(x))
    return x


def rows_of(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(value(r[i]) for i in order)) for r in rows)


def compare(spark, con, name: str, query, sql: str | None, folder: str) -> tuple[bool, str]:
    t = time.time()
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return True, f"{name}: {len(got)} rows, no SQL, {took:.1f} s"
    res = con.execute(sql)
    columns = [c[0] for c in res.description]
    want = res.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} against {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return False, f"{name}: {len(a)} rows against {len(b)}; only here {only[0]}, only in SQL {only[1]}"
    return True, f"{name}: {len(a)} rows equal, {took:.1f} s {hashlib.md5(''.join(a).encode()).hexdigest()[:6]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from orebody.plans.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        try:
            ok, said = compare(spark, con, name, queries[name], sql.get(name), folder)
        except Exception as e:  # noqa: BLE001
            ok, said = False, f"{name}: {type(e).__name__} {str(e)[:600]}"
        bad += not ok
        print("ok  " if ok else "BAD ", said, flush=True)
    print("bad:", bad)
