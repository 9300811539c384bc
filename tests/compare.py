"""Order-insensitive comparison of a Spark query with its DuckDB SQL."""

from __future__ import annotations

import duckdb

from recordloom.plans.derived import TABLES

SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _sorted(rows, columns, order):
    places = [columns.index(c) for c in order]
    return sorted(tuple(repr(row[p]) for p in places) for row in rows)


def check(df, con, sql: str) -> None:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    order = sorted(df.columns)
    assert order == sorted(names)
    assert {f.name: SAME_TYPE[f.dataType.simpleString()] for f in df.schema} == kinds
    found = _sorted([tuple(r) for r in df.collect()], df.columns, order)
    wanted = _sorted(expected, names, order)
    assert len(found) == len(wanted)
    assert found == wanted
