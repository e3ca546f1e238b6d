"""Compare queries with their SQL on the given tables: ``python tests/check_oracles.py [sf folder] [name ...]``."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows by value, times in microseconds, every missing value the same."""
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        column = frame[name]
        if pd.api.types.is_datetime64_any_dtype(column):
            frame[name] = column.astype("datetime64[us]").astype(str)
        elif pd.api.types.is_float_dtype(column):
            frame[name] = column.astype(float).map(lambda v: "null" if np.isnan(v) else repr(round(v, 9) + 0.0))
        else:
            frame[name] = column.map(lambda v: "null" if v is None or v is pd.NA or v is pd.NaT or v != v else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"{len(spark_frame)} rows and {len(sql_frame)} rows"
    mine, theirs = normal(spark_frame), normal(sql_frame)
    wrong = (mine != theirs).any(axis=1)
    if wrong.any():
        return f"{int(wrong.sum())} rows differ:\n{mine[wrong].head(3)}\n{theirs[wrong].head(3)}"
    kinds = {c: (str(spark_frame[c].dtype), str(sql_frame[c].dtype)) for c in spark_frame.columns}
    odd = {c: k for c, k in kinds.items() if k[0].rstrip("]nus[") != k[1].rstrip("]nus[")}
    return f"types {odd}" if odd else None


def main(folder: str, chosen: list[str]) -> int:
    import __spark_entry__ as entry
    from herdsignal.session import local_session

    spark = local_session("check")
    connection = connect(folder)
    oracles, failed = entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        began = time.time()
        try:
            result = query(spark, folder).toPandas()
            took = time.time() - began
            if name in oracles:
                problem = differences(result, connection.execute(oracles[name]).df())
                state = "ok" if problem is None else f"WRONG {problem}"
            else:
                problem, state = None, "no sql"
        except Exception as error:  # report and go on with the next query
            problem, state, took = str(error), "FAILED " + "".join(traceback.format_exception_only(error))[:1500], time.time() - began
            result = pd.DataFrame()
        if problem is not None:
            failed.append(name)
        print(f"{name:28} {took:6.1f}s {len(result):8} rows  {state}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    arguments = sys.argv[1:]
    sys.exit(main(arguments[0] if arguments else "/root/testdata/sf0.01", arguments[1:]))
