"""Run queries against their SQL: ``python -m checks.verify FOLDER [name part …]``."""

from __future__ import annotations

import sys
import tempfile
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks import load_all

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, con, folder: str, name: str, check) -> str:
    """Empty text when the results agree, else what differs."""
    df = check.run(spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if check.sql is None:
        return "" if sum(got.values()) else "no rows"
    cur = con.execute(check.sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        return f"{sum(got.values())} rows / {sum(want.values())} wanted; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
    return "" if sum(got.values()) else "no rows on both sides"


def session(cpus: int = 8, parts: int = 8) -> SparkSession:
    """A local session for checks, benches and tests; its checkpoints go to a folder of its own and are removed when unused."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("checks")
        .config("spark.ui.enabled", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    )


def main(folder: str, parts: list[str]) -> int:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, c in load_all().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            problem = compare(spark, con, folder, name, c)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.1f}s {problem}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
