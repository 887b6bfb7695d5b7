"""Run registered queries beside their SQL and compare rows and values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from datetime import date, datetime

import duckdb


TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    return str(v)


def _sorted_rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, name: str, query, sql: str, folder: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, folder)
    got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    expected = _sorted_rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"{name}: columns {sorted(df.columns)} != {sorted(names)}"
    types = {n: TYPES.get(t, t) for n, t in df.dtypes}
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if types != described:
        return f"{name}: types {types} != {described}"
    if len(got) != len(expected):
        return f"{name}: {len(got)} rows != {len(expected)}"
    for a, b in zip(got, expected, strict=True):
        if a != b or any(type(x) is bool and type(y) is not bool for x, y in zip(a, b, strict=True)):
            return f"{name}: {str(a)[:600]} != {str(b)[:600]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from auditlens.session import build_session

    data = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    session = build_session(cores="8")
    session.sparkContext.setLogLevel("ERROR")
    db = connect(data)
    sql = oracle_sql()
    wanted = sys.argv[1:] or list(queries())
    for key in wanted:
        t0 = time.time()
        try:
            problem = differences(session, db, key, queries()[key], sql[key], data)
        except Exception as e:  # report and go on to the next query
            problem = f"{key}: {type(e).__name__} {str(e)[:700]}"
        print("ok  " if problem is None else "DIFF", key, round(time.time() - t0, 1), problem or "", flush=True)
