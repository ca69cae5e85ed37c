"""Run registered queries beside their SQL and compare by value."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None or isinstance(v, (str, bool, bytes)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    try:
        return norm(float(v))
    except (TypeError, ValueError):
        return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - t0
    if sql is None:
        return bool(df.columns), f"rows only: {len(got)} rows, {took:.1f}s"
    cur = con.execute(sql)
    names, want = [c[0] for c in cur.description], cur.fetchall()
    kinds = {c[0]: str(c[1]) for c in cur.description}
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    mine = dict(df.dtypes)
    odd = [f"{c}:{mine[c]}/{kinds[c]}" for c in names if (mine[c], kinds[c]) not in SAME and not mine[c].startswith("array")]
    note = f" types {odd}" if odd else ""
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return False, f"{len(a)} vs {len(b)} rows; {sorted(names)} {diff}{note}"
    return True, f"{len(a)} rows, {took:.1f}s{note}"


SAME = {("string", "VARCHAR"), ("int", "INTEGER"), ("bigint", "BIGINT"), ("double", "DOUBLE"), ("boolean", "BOOLEAN")}

if __name__ == "__main__":
    from concord.session import local_session
    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    con = connect(sf)
    bad = []
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, name, fn, oracle_sql().get(name), sf)
        except Exception as e:
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
