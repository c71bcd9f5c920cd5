"""Compare every bound query with its oracle on one data folder.

    python -m listflow.suite.check /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import logging
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession, types as T

from listflow.session import local_session
from listflow.suite import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
TYPE_NAMES = {
    T.LongType: "BIGINT", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf: str) -> str:
    """``ok`` or what differs."""
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return f"ok (rows only: {len(got)})" if got else "no rows"
    rel = con.sql(ORACLES[name])
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    for f in df.schema:
        expected = TYPE_NAMES.get(type(f.dataType))
        if kinds[f.name] != expected:
            return f"type of {f.name}: {f.dataType.simpleString()} != {kinds[f.name]}"
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    place = [rel.columns.index(df.columns[i]) for i in order]
    a = sorted(tuple(_plain(r[i]) for i in order) for r in got)
    b = sorted(tuple(_plain(r[i]) for i in place) for r in want)
    if len(a) != len(b):
        extra = [r for r in a if r not in set(b)][:2]
        return f"rows {len(a)} != {len(b)}; only here {extra}"
    if a != b:
        diff = next((x, y) for x, y in zip(a, b) if x != y)
        return f"values differ in {sum(x != y for x, y in zip(a, b))} rows: {diff}"
    return f"ok ({len(a)} rows)" if a else "no rows on either side"


def main() -> int:
    sf, names = sys.argv[1], sys.argv[2:]
    spark, con, bad = local_session(8), connect(sf), 0
    spark.sparkContext.setLogLevel("OFF")
    logging.disable(logging.CRITICAL)
    for name in [n for n in QUERIES if not names or any(n.startswith(x) for x in names)]:
        start = time.time()
        try:
            result = compare(spark, con, name, sf)
        except Exception as e:  # report and go on with the next query
            result = f"{type(e).__name__}: {str(e)[:500]}"
        if not result.startswith("ok"):
            bad += 1
        print(f"{name:32s} {time.time() - start:6.2f}s {result[:1800]}", flush=True)
    print(f"{bad} of {len(QUERIES)} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
