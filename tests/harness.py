"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows, whatever their order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """A value that is equal in both engines."""
    if isinstance(x, decimal.Decimal):
        return plain(float(x))
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return float(f"{x:.9g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    return x


def from_duckdb(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def from_spark(df) -> tuple[list[str], Counter]:
    names = df.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i].asDict() if hasattr(r[i], "asDict") else r[i]) for i in order) for r in df.collect())


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    names, got = from_spark(df)
    wanted_names, wanted = from_duckdb(sql, sf_dir)
    if names != wanted_names:
        return f"columns {names} and {wanted_names}"
    extra, missing = got - wanted, wanted - got
    if extra or missing:
        return f"{sum(got.values())} rows and {sum(wanted.values())}; {sum(extra.values())} only in Spark, such as {list(extra)[:2]}; {sum(missing.values())} only in SQL, such as {list(missing)[:2]}"
    return ""
