"""Run catalog queries beside their SQL and report differences.

``python -m tests.compare [scale] [names...]``
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

import __spark_entry__ as spark_entry
from curbflow.session import local_session

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(value):
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value) or value is pd.NA:
            return ""
        if isinstance(value, float):
            return repr(float(value))
        return str(value)

    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def kinds(schema: dict[str, str]) -> dict[str, str]:
    names = {
        "bigint": "long", "integer": "int", "int32": "int", "double": "double", "varchar": "string",
        "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "date", "boolean": "boolean",
    }
    return {k: names.get(v.lower(), v.lower()) for k, v in schema.items()}


def difference(spark, con, sf_dir: str, name: str, build, sql: str) -> str | None:
    """None when both engines agree, else what differs."""
    df = build(spark, sf_dir)
    ours = df.toArrow().to_pandas(integer_object_nulls=True, date_as_object=True)
    relation = con.sql(sql)
    theirs = relation.to_arrow_table().to_pandas(integer_object_nulls=True, date_as_object=True)
    left = kinds({f.name: f.dataType.simpleString() for f in df.schema.fields})
    right = kinds(dict(zip(relation.columns, map(str, relation.types))))
    renamed = {"bigint": "long"}
    left = {k: renamed.get(v, v) for k, v in left.items()}
    if left != right:
        odd = {k: (left.get(k), right.get(k)) for k in {*left, *right} if left.get(k) != right.get(k)}
        return f"schema {odd}"
    a, b = canonical(ours), canonical(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}" if wrong else None


def main(scale: str = "0.01", *names: str) -> int:
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{scale}"
    con = connection(sf_dir)
    queries, oracles = spark_entry.queries(), spark_entry.oracle_sql()
    unknown = set(oracles) - set(queries)
    bad = [f"oracle without query: {sorted(unknown)}"] if unknown else []
    for name in names or queries:
        start = time.time()
        try:
            if name in oracles:
                found = difference(spark, con, sf_dir, name, queries[name], oracles[name])
            else:
                found = None if queries[name](spark, sf_dir).count() >= 0 else "no rows"
        except Exception as problem:  # report and go on with the next query
            found = f"{type(problem).__name__}: {str(problem)[:600]}"
        note = "" if name in oracles else " (rows only)"
        print(f"{'ok  ' if found is None else 'FAIL'} {name}{note} {time.time() - start:.1f}s {found or ''}", flush=True)
        if found:
            bad.append(name)
    print(f"{len(bad)} problems: {bad}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]) > 0)
