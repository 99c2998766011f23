"""Run registered queries beside their DuckDB text and report differences.

``python -m tests.oracle [name ...]`` checks the given names, or all.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

from skyledger.plans.views import TABLES

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v) -> str:
    if v is None or v is pd.NaT:
        return "~"
    if isinstance(v, float):
        return "~" if math.isnan(v) else repr(v)
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return str(bool(v))
    if hasattr(v, "item"):
        return _cell(v.item())
    return str(v)


def normalise(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark_df, sql: str, con) -> str | None:
    got_rows = [tuple(r) for r in spark_df.collect()]
    got = normalise(got_rows, spark_df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = normalise(cur.fetchall(), names)
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; columns {sorted(names)}; first {bad[:2]}"
    return None


def main(names: list[str]) -> int:
    import __spark_entry__ as entry
    from skyledger.session import build_session

    spark = build_session()
    con = duck()
    queries, oracles = entry.queries(), entry.oracle_sql()
    wrong = 0
    chosen = [q for q in queries if not names or any(n in q for n in names)]
    for name in chosen:
        start = time.time()
        try:
            df = queries[name](spark, SF_DIR)
            if name in oracles:
                problem = compare(df, oracles[name], con)
                n = ""
            else:
                problem = None
                n = f" rows-only {df.count()}"
        except Exception as e:  # report and go on with the next query
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", ""
        wrong += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s{n} {problem or ''}", flush=True)
    print(f"{len(chosen) - wrong} of {len(chosen)} agree")
    return 1 if wrong else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
