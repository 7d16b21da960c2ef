"""Compare a registered query with its SQL twin: `python -m tests.oracle [--sf 0.01] [name …]`."""

from __future__ import annotations

import datetime as dt
import math
import pathlib
import signal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if pathlib.Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.date() if value.time() == dt.time() else value
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def _kind(value) -> str:
    return "bool" if isinstance(value, bool) else type(value).__name__


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    spark_columns, spark_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    sql_columns, sql_rows = _rows(names, cursor.fetchall())
    if spark_columns != sql_columns:
        return f"columns {spark_columns} != {sql_columns}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    if spark_rows != sql_rows:
        bad = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
        return f"{len(bad)} of {len(sql_rows)} rows differ, first {bad[0]}"
    for a, b in zip(spark_rows, sql_rows):
        if [_kind(x) for x in a] != [_kind(x) for x in b]:
            return f"types differ: {a} {b}"
    return None if sql_rows else "empty on both sides"


LIMIT = 120  # seconds a query may take


def _late(*_):
    raise TimeoutError(f"more than {LIMIT} s")


def main(argv: list[str]) -> int:
    from demandloom.session import local_session

    signal.signal(signal.SIGALRM, _late)
    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    from demandloom.plans import registered, registered_sql

    spark, con = local_session("8"), connect(sf_dir)
    builders, twins, failures = registered(), registered_sql(), 0
    names = [n for n in builders if not argv or any(n.startswith(a) for a in argv)]
    for name in names:
        start = time.time()
        signal.alarm(LIMIT)
        try:
            if name in twins:
                verdict = compare(builders[name](spark, sf_dir), con, twins[name])
            else:
                n = builders[name](spark, sf_dir).count()
                verdict = None if n else "no rows"
        except Exception as error:  # report and go on
            verdict = f"{type(error).__name__}: {str(error)[:400]}"
        signal.alarm(0)
        failures += verdict is not None
        mark = "ok  " if verdict is None else "FAIL"
        print(f"{mark} {name} {time.time() - start:.1f}s {'' if name in twins else '(rows only) '}{verdict or ''}", flush=True)
    print(f"{len(names) - failures}/{len(names)}")
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
