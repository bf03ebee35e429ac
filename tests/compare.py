"""Run registered queries beside their SQL twins: python tests/compare.py [sf_dir] [name …]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


FAMILY = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value) if value is not None else "\x00"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows), [columns[i] for i in order]


def compare(spark, con, name, query, sql, sf):
    """(seconds, number of rows, problem or None)"""
    begin = time.time()
    df = query(spark, sf)
    got, got_columns = rows_of(df.columns, df.collect())
    seconds = time.time() - begin
    if sql is None:
        return seconds, len(got), None if got else "no rows"
    cursor = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cursor.description}
    odd = {f.name: (FAMILY.get(f.dataType.simpleString(), "?"), types.get(f.name)) for f in df.schema.fields}
    odd = {k: v for k, v in odd.items() if v[0] != v[1]}
    if odd:
        return seconds, len(got), f"types {odd}"
    want, want_columns = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return seconds, len(got), f"columns {got_columns} instead of {want_columns}"
    if got != want:
        here, there = set(got) - set(want), set(want) - set(got)
        sample = f"{sorted(here)[:2]} | {sorted(there)[:2]}"
        return seconds, len(got), f"{len(got)} rows instead of {len(want)}; differ {len(here)}/{len(there)}: {sample[:600]}"
    return seconds, len(got), None


def main():
    from __spark_entry__ import oracle_sql, queries
    from wordloom.session import spark_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = spark_session(
        "compare",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf), oracle_sql()
    bad = []
    for name, query in queries().items():
        if chosen and name not in chosen:
            continue
        try:
            seconds, n, problem = compare(spark, con, name, query, sqls.get(name), sf)
        except Exception as error:  # keep going: the report lists every failure
            seconds, n, problem = 0.0, 0, f"{type(error).__name__}: {str(error)[:700]}"
        kind = "sql" if name in sqls else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:28s} {kind} {n:8d} rows {seconds:6.2f}s {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
