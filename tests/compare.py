"""Run registered queries and their comparison SQL side by side."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connection(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def compare(df, con, sql: str) -> str:
    """Empty when equal, else the first difference."""
    columns = sorted(df.columns)
    rows = [tuple(canonical(r[c]) for c in columns) for r in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    order = [names.index(c) for c in columns]
    other = [tuple(canonical(r[i]) for i in order) for r in result.fetchall()]
    kinds = {c: t for c, t in df.dtypes}
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c in columns:
        if pairs.get(kinds[c]) != described[c]:
            return f"type of {c}: {kinds[c]} != {described[c]}"
    key = lambda row: tuple((v is None, str(v)) for v in row)
    rows.sort(key=key)
    other.sort(key=key)
    if len(rows) != len(other):
        extra = [r for r in rows if r not in set(other)][:2], [r for r in other if r not in set(rows)][:2]
        return f"{len(rows)} rows != {len(other)} rows; {str(extra)[:900]}"
    for a, b in zip(rows, other, strict=True):
        if a != b:
            return f"{columns}: {str(a)[:600]} != {str(b)[:600]}"
    return "" if rows else "EMPTY"


if __name__ == "__main__":
    import re

    import __spark_entry__ as entry
    from inkwarden.session import local_session

    sf_dir, pattern = sys.argv[1], sys.argv[2] if len(sys.argv) > 2 else "."
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(sf_dir)
    oracle = entry.oracle_sql()
    for name, query in entry.queries().items():
        if not re.search(pattern, name):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracle:
                message = compare(df, con, oracle[name])
                note = "OK" if not message else f"DIFF {message}"
            else:
                note = f"ROWS {df.count()}"
        except Exception as error:  # noqa: BLE001
            note = f"FAIL {str(error)[:900]}"
        print(f"@@ {name:28s} {time.time() - start:6.1f}s {note}", flush=True)
