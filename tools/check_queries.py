"""Run registered queries on Spark and their SQL checks on DuckDB; report differences.

usage: python tools/check_queries.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from amberline.plans import oracle_sql, queries  # noqa: E402
from amberline.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, float):
        return ("f", None if math.isnan(v) else v)
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, datetime.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, datetime.date):
        return ("d", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(plain(x) for x in v))
    if isinstance(v, dict):
        return ("m", tuple(sorted((k, plain(x)) for k, x in v.items())))
    return ("s", v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def close(a, b):
    if a[0] == "f" and b[0] == "f" and a[1] is not None and b[1] is not None:
        return abs(a[1] - b[1]) <= 1e-9 * max(1.0, abs(a[1]))
    return a == b


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got_names = df.columns
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return "ROWS", f"{len(got)} rows", took
    rel = con.sql(sql)
    want_names = rel.columns
    want = rel.fetchall()
    if sorted(got_names) != sorted(want_names):
        return "COLUMNS", f"spark {sorted(got_names)} sql {sorted(want_names)}", took
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if a == b:
        return ("OK" if a else "EMPTY"), f"{len(a)} rows", took
    if len(a) != len(b):
        return "COUNT", f"spark {len(a)} sql {len(b)}", took
    near = all(len(x) == len(y) and all(close(p, q) for p, q in zip(x, y)) for x, y in zip(a, b))
    diff = next((x, y) for x, y in zip(a, b) if x != y)
    return ("FLOAT" if near else "VALUES"), f"{sorted(got_names)}\n   spark {diff[0]}\n   sql   {diff[1]}", took


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.log.level": "OFF", "spark.ui.showConsoleProgress": "false"})
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    checks, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            status, detail, took = compare(spark, con, name, fn, checks.get(name), sf_dir)
        except Exception as exc:  # report and go on with the next query
            status, detail, took = "ERROR", str(exc)[:700], 0.0
        bad += status not in ("OK", "ROWS")
        print(f"{status:8s} {took:6.2f}s {name}: {detail}", flush=True)
    print(f"{bad} problem(s)")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
