"""Run a query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql: str) -> tuple[bool, str]:
    spark_names, spark_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    sql_names, sql_rows = _rows(names, cursor.fetchall())
    if spark_names != sql_names:
        return False, f"columns {spark_names} vs {sql_names}"
    if len(spark_rows) != len(sql_rows):
        extra = [r for r in spark_rows if r not in set(sql_rows)][:2]
        lack = [r for r in sql_rows if r not in set(spark_rows)][:2]
        return False, f"{len(spark_rows)} rows vs {len(sql_rows)}; extra {extra}; lacking {lack}"
    bad = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(sql_rows)} rows differ, first {bad[0]}"
    kinds = [
        (n, type(a).__name__, type(b).__name__)
        for n, a, b in zip(spark_names, spark_rows[0], sql_rows[0])
        if type(a) is not type(b)
    ] if spark_rows else []
    return True, f"{len(sql_rows)} rows{' kinds ' + str(kinds) if kinds else ''}"
