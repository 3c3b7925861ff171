"""Run queries and their SQL side by side on the same Parquet files."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "tzinfo"):
        return x.replace(tzinfo=None)
    return tuple(map(_plain, x)) if isinstance(x, list) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr), [names[i] for i in order]


def differences(df, con, sql) -> list:
    """Empty if the columns and rows agree, else what does not."""
    got, columns = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want, expected = rows([d[0] for d in result.description], result.fetchall())
    if columns != expected:
        return [("columns", columns, expected)]
    if got == want:
        return []
    missing, extra = set(want) - set(got), set(got) - set(want)
    return [("rows", len(got), len(want)), *sorted(missing, key=repr)[:2], "--", *sorted(extra, key=repr)[:2]]
