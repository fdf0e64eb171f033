"""Run registered queries on Spark and their oracle SQL on DuckDB; compare
row count, column names and order-insensitive values.

    python tools/check_oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from tableflow.queries import ORACLES, QUERIES  # noqa: E402
from tableflow.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return f"{v:.9g}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{canon(k)}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    return str(v)


# Spark simple type names -> DuckDB result type names.
SPARK_TO_DUCKDB = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE",
    "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def type_mismatches(spark_dtypes, duck_names, duck_types) -> dict:
    s = {c: SPARK_TO_DUCKDB.get(t, t) for c, t in spark_dtypes}
    o = {c: str(t) for c, t in zip(duck_names, duck_types)}
    return {c: (s.get(c), o.get(c)) for c in sorted(set(s) | set(o)) if s.get(c) != o.get(c)}


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows), sorted(names)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in wanted:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            s, scols = rows_of(df.columns, srows)
        except Exception as e:  # report and go on
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        secs = time.time() - t0
        if name not in ORACLES:
            print(f"ROWS {name}: {len(s)} rows (no oracle) {secs:.1f}s")
            continue
        try:
            rel = con.sql(ORACLES[name])
            dnames, dtypes = rel.columns, rel.types
            o, ocols = rows_of(dnames, rel.fetchall())
        except Exception as e:
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        types = type_mismatches(df.dtypes, dnames, dtypes)
        if types:
            print(f"FAIL {name}: types {types}")
            bad += 1
        elif scols != ocols:
            print(f"FAIL {name}: columns {scols} vs {ocols}")
            bad += 1
        elif len(s) != len(o):
            print(f"FAIL {name}: rows {len(s)} vs {len(o)}")
            bad += 1
        elif s != o:
            diff = next(i for i in range(len(s)) if s[i] != o[i])
            print(f"FAIL {name}: values differ, first at {diff}: {s[diff]} vs {o[diff]}")
            bad += 1
        else:
            print(f"OK   {name}: {len(s)} rows {secs:.1f}s")
    print(f"{len(wanted) - bad}/{len(wanted)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
