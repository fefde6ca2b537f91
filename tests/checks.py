"""Compare queries with their SQL twins: row count, types and values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "FLOAT": "float", "TIMESTAMP": "timestamp", "DATE": "date",
}


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark result and a SQL result; empty when equal."""
    rel = con.sql(sql)
    want_types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    got_types = dict(df.dtypes)
    out = []
    if set(want_types) != set(got_types):
        return [f"columns {sorted(got_types)} != {sorted(want_types)}"]
    for n, t in want_types.items():
        if KINDS.get(t, t) != got_types[n]:
            out.append(f"type of {n}: {got_types[n]} != {t}")
    names = sorted(want_types)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    at = [rel.columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        out.append(f"values differ: {len(a - b)} / {len(b - a)}; {sorted(a - b)[:2]} vs {sorted(b - a)[:2]}")
    return out


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tidewheel.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("local[8]", "checks", 8, "12g")
    con = connect(folder)
    oracle = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            problems = compare(df, con, oracle[name]) if name in oracle else [] if df.count() >= 0 else []
        except Exception as e:
            problems = [f"{type(e).__name__}: {str(e)[:700]}"]
        bad += bool(problems)
        mark = "ok " if not problems else "BAD"
        kind = "" if name in oracle else " (rows only)"
        print(f"{mark} {name}{kind} {time.time() - start:.1f}s {' | '.join(problems)}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
