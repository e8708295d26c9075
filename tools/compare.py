"""Run registered queries on Spark and their check SQL on DuckDB and compare the results.

    python tools/compare.py [--sf 0.01] [name ...]
"""

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plateflow import plans  # noqa: E402
from plateflow.fixtures import BASE_TABLES  # noqa: E402
from plateflow.session import local_session  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (bool, str)):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return float(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, folder, name):
    started = time.time()
    frame = plans.queries()[name](spark, folder)
    table = frame.toArrow()
    spent = time.time() - started
    columns = table.column_names
    got = rows_of(columns, zip(*[c.to_pylist() for c in table.columns])) if columns else []
    sql = plans.oracle_sql().get(name)
    if sql is None:
        return f"rows {len(got)}", spent
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = rows_of(want_columns, cursor.fetchall())
    if sorted(columns) != sorted(want_columns):
        return f"COLUMNS {sorted(columns)} != {sorted(want_columns)}", spent
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}", spent
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    if wrong:
        return f"VALUES {len(wrong)} of {len(got)} {sorted(columns)}: {wrong[0]}", spent
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    odd = [f"{n}:{t}/{kinds[n]}" for n, t in frame.dtypes if {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}.get(t) != kinds[n]]
    return f"ok {len(got)}" + (f" TYPES {odd}" if odd else ""), spent


def main():
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(), connect(folder)
    bad = 0
    for name in args.names or plans.queries():
        try:
            result, spent = compare(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            result, spent = f"ERROR {type(error).__name__}: {str(error)[:700]}", 0.0
        bad += not result.startswith(("ok", "rows")) or "TYPES" in result
        print(f"{name:32s} {spent:6.2f}s {result}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
