"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

``python -m checks.compare [sf] [name prefix ...]``; ``CHECK_CONF="key=value ..."`` sets session
options, for example ``spark.sql.autoBroadcastJoinThreshold=-1`` to check the shuffled plans.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for option in os.environ.get("CHECK_CONF", "").split():
        builder = builder.config(*option.split("=", 1))
    return builder.getOrCreate()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return v
    return str(v)


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, run, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = run(spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    if sql is None:
        return True, f"{len(rows)} rows, no SQL, {took:.1f}s"
    cur = con.execute(sql)
    theirs_cols = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(theirs_cols):
        return False, f"columns {sorted(df.columns)} != {sorted(theirs_cols)}"
    a, b = bag(df.columns, rows), bag(theirs_cols, theirs)
    if a != b:
        return False, (
            f"{len(rows)} vs {len(theirs)} rows; {sorted(df.columns)}"
            f" only here {list((a - b).items())[:3]} only there {list((b - a).items())[:3]}"
        )
    return True, f"{len(rows)} rows, {took:.1f}s"


def main(argv: list[str]) -> int:
    from checks.queries import ORACLES, QUERIES

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    wanted = argv[1:]
    spark, con = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, run, ORACLES.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
