"""Run queries next to their SQL on DuckDB and compare the rows, whatever their order."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        kind = frame[name].dtype
        if kind.kind == "M":
            frame[name] = frame[name].astype("datetime64[us]")
        elif kind.kind in "iuf":
            frame[name] = frame[name].astype("float64")
        elif kind == object and len(frame) and hasattr(frame[name].dropna().head(1).squeeze(), "isoformat"):
            frame[name] = pd.to_datetime(frame[name]).astype("datetime64[us]")
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def differences(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    mine = normal(fn(spark, sf_dir).toPandas())
    theirs = normal(con.execute(sql).df())
    if list(mine.columns) != list(theirs.columns):
        return f"columns {list(mine.columns)} / {list(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    try:
        pd.testing.assert_frame_equal(mine, theirs, check_dtype=False, check_exact=True)
    except AssertionError as error:
        return str(error)
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from wickwork.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:] or list(entry.queries())
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = differences(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
