"""Runs a registered query in Spark and its SQL in DuckDB, and compares all rows."""

from __future__ import annotations

import glob
import os

import duckdb


# No pairs of everything with everything, and no rows through Python.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups")


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark, build, sql: str, folder: str) -> tuple[int, str]:
    """Number of Spark rows and a description of the first difference ('' if none)."""
    frame = build(spark, folder)
    mine = rows_of(frame.columns, frame.collect())
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for node in FORBIDDEN:
        if node in plan:
            return len(mine), f"plan has {node}"
    cursor = duck(folder).execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(frame.columns):
        return len(mine), f"columns {sorted(frame.columns)} != {sorted(names)}"
    if mine == theirs:
        return len(mine), ""
    extra = [r for r in mine if r not in set(theirs)][:1]
    missing = [r for r in theirs if r not in set(mine)][:1]
    return len(mine), f"rows {len(mine)} / {len(theirs)}; only spark {extra!r:.600}; only sql {missing!r:.600}"
