"""Runs registered queries beside their SQL and compares the rows.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir, query, sql):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    s_cols, s_rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if s_rows else "no rows"
    cur = con.execute(sql)
    d_cols, d_rows = canonical([d[0] for d in cur.description], cur.fetchall())
    if s_cols != d_cols:
        return f"columns {s_cols} != {d_cols}"
    if not s_rows:
        return "no rows"
    if len(s_rows) != len(d_rows):
        return f"{len(s_rows)} rows != {len(d_rows)}"
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    return f"{len(bad)} rows differ, e.g.\n   spark {bad[0][0]}\n   sql   {bad[0][1]}" if bad else None


def main():
    from cohortry.plans import registry
    from cohortry.session import build_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(a.sf)
    names = a.names or list(registry.QUERIES)
    failed = []
    for name in names:
        t = time.time()
        try:
            diff = compare(spark, con, name, a.sf, registry.QUERIES[name],
                           registry.ORACLE.get(name))
        except Exception as e:  # noqa: BLE001 - reported per query
            diff = f"{type(e).__name__}: {str(e)[:900]}"
        kind = "sql " if name in registry.ORACLE else "rows"
        print(f"{'ok  ' if diff is None else 'FAIL'} {kind} {time.time() - t:6.2f}s {name}"
              + (f"  {diff}" if diff else ""), flush=True)
        if diff:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
