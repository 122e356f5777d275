"""Run queries beside their SQL in DuckDB: python -m tests.verify [--sf DIR] [NAME...]."""

from __future__ import annotations

import datetime
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def norm(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(norm(v) for v in x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(norm(r[k]) for k in order) for r in rows), key=repr)


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def compare(spark, con, folder, name, query, sql):
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return f"rows only: {len(got)}", True
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} against {sorted(rel.columns)}", False
    close = lambda a, b: a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    off = [(a, b) for a, b in zip(got, want) if not all(close(x, y) for x, y in zip(a, b))]
    if len(got) != len(want) or off:
        return f"{len(got)} rows against {len(want)}, {len(off)} differ; first {off[:1]}", False
    exact = got == want
    return f"equal, {len(got)} rows" + ("" if exact else " (within 1e-9)"), exact


def main(args: list[str]) -> int:
    import __spark_entry__ as e
    from marlstone.session import get_session

    folder = args[args.index("--sf") + 1] if "--sf" in args else "/root/testdata/sf0.01"
    names = [a for k, a in enumerate(args) if a[0] != "-" and (k == 0 or args[k - 1] != "--sf")]
    spark = get_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name, q in e.queries().items():
        if names and not any(name == n or n.endswith("*") and name.startswith(n[:-1]) for n in names):
            continue
        t = time.time()
        try:
            said, ok = compare(spark, con, folder, name, q, e.oracle_sql().get(name))
        except Exception as x:  # noqa: BLE001
            said, ok = f"{type(x).__name__}: {str(x)[:700]}", False
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - t:.1f}s {said}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
