"""Compare registered queries with their SQL oracles in DuckDB, value by value."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    return {"int": "number", "float": "number", "Decimal": "decimal"}.get(
        type(value).__name__, type(value).__name__)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = [tuple((_kind(r[i]), repr(float(r[i])) if _kind(r[i]) == "number" else str(r[i]))
                   for i in order) for r in rows]
    return [columns[i] for i in order], sorted(shown)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        return f"{len(bad)} of {len(got)} rows differ; first: " + ", ".join(
            f"{c}: {a} != {b}" for c, a, b in zip(got_cols, g, w) if a != b)
    return None


def main() -> None:
    from dunwright.plans import oracle_sql, queries
    from dunwright.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    con = oracle_connection(folder)
    oracles, wanted = oracle_sql(), sys.argv[1:]
    failed = 0
    for name, run in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = difference(run(spark, folder), con, oracles[name])
            else:
                problem = None if run(spark, folder).count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.2f}s "
              f"{'' if name in oracles else '(rows only) '}{problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
