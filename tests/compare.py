"""Runs a registered query in Spark and its twin in DuckDB and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral() else float(value)
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(plain(r[i])) for i in order) for r in rows)


def expected(sf_dir: str, name: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    return [d[0] for d in cur.description], [str(d[1]) for d in cur.description], cur.fetchall()


def check(spark, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in entry.oracle_sql():
        return True, f"{len(rows)} rows, no twin, {took:.1f}s"
    names, types, other = expected(sf_dir, name)
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    left, right = table(rows, df.columns), table(other, names)
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    known = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    off = [
        (n, spark_types[n], t) for n, t in zip(names, types) if known.get(t, t) != spark_types[n]
    ]
    if left != right:
        a, b = set(left), set(right)
        return False, (
            f"{len(left)} rows != {len(right)}; {sorted(df.columns)}; "
            f"spark only {sorted(a - b)[:2]}; duckdb only {sorted(b - a)[:2]}; types {off}"
        )
    return (not off), f"{len(left)} rows, {took:.1f}s" + (f", types {off}" if off else "")


if __name__ == "__main__":
    from session import make_session

    spark = make_session()
    folder = sys.argv[1]
    wanted = sys.argv[2:] or list(entry.queries())
    for name in wanted:
        try:
            ok, text = check(spark, folder, name)
        except Exception as error:  # report and go on with the next query
            ok, text = False, f"{type(error).__name__}: {str(error)[:600]}"
        print("ok  " if ok else "FAIL", name, text[:1500], flush=True)
