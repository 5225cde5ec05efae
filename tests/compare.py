"""Spark results beside DuckDB results, cell by cell."""

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "\x00null"
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return str(value)


def _rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(
        tuple(_cell(v) for v in row) for row in frame[columns].astype(object).values.tolist()
    )


def kinds(frame):
    return {c: frame[c].dtype.kind for c in sorted(frame.columns)}


def differences(df, sql, con):
    ours = df.toPandas()
    theirs = con.execute(sql).df()
    # Either side may give whole numbers with nulls as floats.
    for name, kind in df.dtypes:
        for frame in (ours, theirs):
            if kind in ("int", "bigint") and name in frame and frame[name].dtype.kind in "iuf":
                frame[name] = frame[name].astype("Int64")
    left, right = _rows(ours), _rows(theirs)
    if left[0] != right[0]:
        return [f"columns {left[0]} / {right[0]}"]
    found = []
    if len(left[1]) != len(right[1]):
        found.append(f"rows {len(left[1])} / {len(right[1])}")
    found += [f"{a} / {b}" for a, b in zip(left[1], right[1]) if a != b][:3]
    return found
