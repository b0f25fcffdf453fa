"""Run registered queries and their SQL twins side by side.

    python tests/oracle_check.py [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from datetime import date, datetime
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat() + "T00:00:00"
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    return value


def kind_of(value) -> str:
    return {datetime: "stamp", date: "date"}.get(type(value), type(value).__name__)


def compare(frame, con, sql: str) -> str:
    names = sorted(frame.columns)
    mine_raw = [tuple(row[n] for n in names) for row in frame.collect()]
    cursor = con.execute(sql)
    described = [d[0] for d in cursor.description]
    if sorted(described) != names:
        return f"columns differ: {names} / {sorted(described)}"
    places = [described.index(n) for n in names]
    theirs_raw = [tuple(row[p] for p in places) for row in cursor.fetchall()]
    for i, name in enumerate(names):
        a = {kind_of(r[i]) for r in mine_raw if r[i] is not None}
        b = {kind_of(r[i]) for r in theirs_raw if r[i] is not None}
        if a and b and a != b:
            return f"type of {name} differs: {a} / {b}"
    mine = sorted((tuple(map(normal, r)) for r in mine_raw), key=repr)
    theirs = sorted((tuple(map(normal, r)) for r in theirs_raw), key=repr)
    if len(mine) != len(theirs):
        return f"rows differ: {len(mine)} / {len(theirs)}; first {mine[:2]} / {theirs[:2]}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ, such as {bad[0]}" if bad else ""


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tablescry.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session("oracle check", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = oracle_sql()
    failed = 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            frame = run(spark, folder)
            result = compare(frame, con, oracles[name]) if name in oracles else f"(rows only: {len(frame.collect())})"
        except Exception as error:  # report every query
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        took = time.time() - start
        ok = not result or result.startswith("(rows")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.1f}s {result}", flush=True)
    unknown = set(oracles) - set(queries())
    if unknown:
        print("oracles without a query:", unknown)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
