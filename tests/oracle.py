"""Run a registered query and its SQL side by side and compare the rows as multisets."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """Differences as text; empty if the results are equal."""
    spark_rows = df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    duck_rows = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(spark_rows)
    ours, theirs = multiset(df.columns, spark_rows), multiset(names, duck_rows)
    if ours == theirs:
        return "", len(spark_rows)
    only, missing = list((ours - theirs).items())[:2], list((theirs - ours).items())[:2]
    return (
        f"rows {len(spark_rows)} / {len(duck_rows)}, differing {sum((ours - theirs).values())}\n"
        f"  spark: {str(only)[:700]}\n  duck:  {str(missing)[:700]}"
    ), len(spark_rows)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plan_problems(df) -> list[str]:
    """What must not be in the plan of a query that is to run on a large cluster.

    A single partition may only receive partial aggregates, or the table of partition sizes of a sorted result.
    """
    lines = plan(df).splitlines()
    banned = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
    found = [w for w in banned for line in lines if w in line]
    for line, below in zip(lines, lines[1:]):
        if "Exchange SinglePartition" in line:
            if not any(w in below for w in ("partial_", "HashAggregate(keys=[_part", "functions=[]")):
                found.append(below.strip())
    return found
