"""Run registered queries next to their oracle SQL.  `python tests/compare.py SF_DIR [name ...]`."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(repr(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out)


def compare(spark, con, sf_dir, query, sql):
    """None if both sides agree, else a message."""
    df = query(spark, sf_dir)
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    expected_columns, expected = rows_of(rel.columns, rel.fetchall())
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if got != expected:
        a, b = set(got), set(expected)
        return (
            f"{len(got)} rows, expected {len(expected)}; "
            f"only spark {sorted(a - b)[:3]} only oracle {sorted(b - a)[:3]}"
        )
    return None if got else "no rows on either side"


def main():
    from __spark_entry__ import oracle_sql, queries
    from tidelog.session import get_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    conf = {"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    conf.update(kv.split("=", 1) for kv in os.environ.get("COMPARE_CONF", "").split(",") if kv)
    spark = get_session("compare", 8, **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    registered, sql = queries(), oracle_sql()
    bad = 0
    for name, query in registered.items():
        if names and not any(name == n or name.startswith(n.rstrip("*")) and n.endswith("*") for n in names):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, sf_dir, query, sql[name])
            else:
                problem = None if query(spark, sf_dir).count() else "no rows"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        kind = "oracle" if name in sql else "rows"
        print(f"{'FAIL' if problem else 'ok'} {name} [{kind}] {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
