"""Compares a query with its SQL oracle: rows and values, without order."""

from __future__ import annotations

import decimal
import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, decimal.Decimal):
        return float(x) if x % 1 else int(x)
    return x


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    """Column names, sorted, and counted rows of a DuckDB statement over the tables of a folder."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_plain(r[i]) for i in order) for r in found.fetchall())


def compare(df, sql: str, sf_dir: str) -> tuple[bool, str]:
    """Whether df has the oracle's rows, and what differs."""
    names, want = oracle_rows(sql, sf_dir)
    if sorted(df.columns) != names:
        return False, f"columns {sorted(df.columns)} and {names}"
    got = Counter(tuple(_plain(x) for x in r) for r in df.select(*names).collect())
    if got == want:
        return True, f"{sum(got.values())} rows"
    return False, f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
