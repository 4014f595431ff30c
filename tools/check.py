"""Run registered queries and compare them with their oracle SQL in DuckDB.

usage: python tools/check.py [--sf DIR] [name-part ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from terralume.queries import load_all  # noqa: E402
from terralume.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return str(value) if value is not None else None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session()
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{args.sf}/{name}.parquet'")
    bad = 0
    for name, q in load_all().items():
        if args.names and not any(part in name or part in q.ids for part in args.names):
            continue
        start = time.time()
        try:
            df = q.run(spark, args.sf)
            cols = sorted(df.columns)
            got = sorted((repr(tuple(plain(r[c]) for c in cols)) for r in df.collect()))
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(exc).__name__} {str(exc)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if q.sql is None:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s (no oracle)", flush=True)
            continue
        try:
            start = time.time()
            res = con.execute(q.sql)
            names = [d[0] for d in res.description]
            order = sorted(range(len(names)), key=lambda i: names[i])
            want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in res.fetchall())
            dtook = time.time() - start
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"SQL   {name}: {str(exc)[:1500]}", flush=True)
            continue
        if sorted(names) != cols:
            bad += 1
            print(f"COLS  {name}: spark {cols} sql {sorted(names)}", flush=True)
        elif got != want:
            bad += 1
            g, w = set(got) - set(want), set(want) - set(got)
            print(f"DIFF  {name}: {len(got)} vs {len(want)} rows", flush=True)
            print("   cols ", cols)
            for row in sorted(g)[:3]:
                print("   spark", row[:700])
            for row in sorted(w)[:3]:
                print("   sql  ", row[:700])
        else:
            empty = " EMPTY" if not got else ""
            print(f"ok    {name}: {len(got)} rows {took:.1f}s sql {dtook:.1f}s{empty}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
