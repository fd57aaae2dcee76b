"""Run a Spark result and its DuckDB twin on the same parquet files and compare them."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()

SPARK_KINDS = {"bigint": "int64", "int": "int32", "double": "double", "string": "string",
               "boolean": "bool", "timestamp": "ts", "timestamp_ntz": "ts", "date": "date", "float": "float"}
DUCK_KINDS = {"BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "double", "VARCHAR": "string",
              "BOOLEAN": "bool", "TIMESTAMP": "ts", "DATE": "date", "FLOAT": "float"}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in DRIVER_TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def _value(x):
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return f"{x:.5f}".replace("-0.00000", "0.00000")
    if isinstance(x, (list, tuple)):
        return tuple(_value(v) for v in x)
    return str(x) if x is not None and not isinstance(x, (bool, int)) else x


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description of the difference."""
    spark_kinds = sorted((f.name, SPARK_KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()))
                         for f in df.schema.fields)
    spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    duck_kinds = sorted((c[0], DUCK_KINDS.get(str(c[1]), str(c[1]))) for c in cur.description)
    duck_rows = rows_of(names, cur.fetchall())
    if spark_kinds != duck_kinds:
        return f"schema: {[a for a in spark_kinds if a not in duck_kinds]} vs {[b for b in duck_kinds if b not in spark_kinds]}"
    if spark_rows != duck_rows:
        a, b = spark_rows - duck_rows, duck_rows - spark_rows
        cols = sorted(names)
        return (f"rows {sum(spark_rows.values())} vs {sum(duck_rows.values())}; cols {cols}; only spark {sum(a.values())}: "
                f"{[str(x)[:400] for x in list(a)[:3]]}; only duckdb {sum(b.values())}: {[str(x)[:400] for x in list(b)[:3]]}")
    return None
