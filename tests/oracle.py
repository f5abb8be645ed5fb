"""Run a registered query next to its SQL twin and compare whole results."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and value != value) or value is pd.NaT:
        return "NULL"
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return repr(value)


def canonical(rows, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}


def compare(spark, con, name, run, sql, sf_dir) -> list[str]:
    """Differences between the two results; empty when they agree."""
    df = run(spark, sf_dir)
    got_types = {c: KINDS.get(t, t) for c, t in df.dtypes}
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    rel = con.sql(sql)
    want_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    want = canonical(rel.fetchall(), rel.columns)
    problems = []
    if got_types != want_types:
        problems.append(f"schema {sorted(set(got_types.items()) ^ set(want_types.items()))}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    if got != want:
        cols = sorted(df.columns)
        extra, lack = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        problems.append(f"{len(extra)} rows differ\n  {cols}\n  spark {extra[:2]}\n  sql   {lack[:2]}")
    if not got:
        problems.append("empty result")
    return problems


def main(names: list[str], sf_dir: str) -> int:
    from slotflow.checks.registry import registered
    from tests.conftest import make_session

    spark, con, bad = make_session(), connect(sf_dir), 0
    for name, (run, sql) in registered().items():
        if names and not any(n in name for n in names):
            continue
        began = time.time()
        try:
            if sql:
                problems = compare(spark, con, name, run, sql, sf_dir)
                note = "sql"
            else:
                rows = run(spark, sf_dir).collect()
                problems, note = ([] if rows else ["empty"]), f"rows only ({len(rows)})"
        except Exception as error:  # noqa: BLE001
            problems, note = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:40s} {time.time() - began:6.1f}s {note}", flush=True)
        for p in problems:
            print("   ", p, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sf = next((a for a in sys.argv[1:] if "/" in a), "/root/testdata/sf0.01")
    sys.exit(bool(main([a for a in sys.argv[1:] if "/" not in a], sf)))
