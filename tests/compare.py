"""Runs registered queries against their DuckDB twins; used by tests and by hand.

    python tests/compare.py [sf_dir] [name-prefix ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def oracle(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, int):
        return value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=repr
    )


def differs(spark, con, sf: str, name: str, fn, sql: str) -> str | None:
    """A short description of the first difference, or None."""
    got = fn(spark, sf)
    mine = rows_of(got.columns, [tuple(r) for r in got.collect()])
    answer = con.sql(sql)
    theirs = rows_of(answer.columns, answer.fetchall())
    if sorted(got.columns) != sorted(answer.columns):
        return f"columns {sorted(got.columns)} vs {sorted(answer.columns)}"
    if len(mine) != len(theirs):
        extra = [r for r in mine if r not in set(theirs)][:2]
        missing = [r for r in theirs if r not in set(mine)][:2]
        return f"{len(mine)} rows vs {len(theirs)}; extra {extra}; missing {missing}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{a} vs {b}"
    return None


def session():
    from pyspark.sql import SparkSession

    from pagelens.settings import configure

    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    spark = configure(builder, shuffle_partitions=8).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    from __spark_entry__ import oracle_sql, queries

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con, sqls = session(), oracle(sf), oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if argv[1:] and not name.startswith(tuple(argv[1:])):
            continue
        started = time.time()
        try:
            if name in sqls:
                said = differs(spark, con, sf, name, fn, sqls[name])
                note = "ok" if said is None else f"DIFFERS {said}"
            else:
                note = f"rows only: {len(fn(spark, sf).collect())}"
        except Exception as exc:
            note = f"FAILED {type(exc).__name__}: {str(exc)[:600]}"
        bad += note.startswith(("DIFFERS", "FAILED"))
        print(f"{name:34s} {time.time() - started:6.2f}s {note}", flush=True)
    print("not matching:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
