"""Holds queries against their SQL in DuckDB over the same tables. As a script: python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):  # noqa: ANN201
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def _plain(x):  # noqa: ANN001, ANN202
    if x is None or isinstance(x, float) and math.isnan(x):
        return (0, "")
    if isinstance(x, bool):
        return (1, str(x))
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return (2, f"{float(x):.9g}")
    if isinstance(x, int):
        return (2, f"{float(x):.9g}") if abs(x) < 1 << 53 else (2, str(x))
    if isinstance(x, list):
        return (3, str([_plain(y) for y in x]))
    return (4, str(x))


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(df, db, sql: str) -> str:  # noqa: ANN001
    """What differs, empty if nothing does."""
    found = db.execute(sql)
    want_columns, want = rows_of([d[0] for d in found.description], found.fetchall())
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got_columns != want_columns:
        return f"columns {got_columns} for {want_columns}"
    if got != want:
        odd = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows for {len(want)}; only here: {odd[0]}; only there: {odd[1]}"
    return ""


if __name__ == "__main__":
    import os

    root = str(Path(__file__).resolve().parents[1])
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = root
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master(os.environ.get("MASTER", "local[8]")).config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, db = entry.queries(), entry.oracle_sql(), database(sys.argv[1])
    for name in sys.argv[2:] or [n for n in queries if n in sql]:
        began = time.time()
        try:
            if name in sql:
                said = difference(queries[name](spark, sys.argv[1]), db, sql[name]) or "same"
            else:
                said = f"no SQL; {queries[name](spark, sys.argv[1]).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"FAILED {type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
