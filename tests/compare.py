"""Compare a query's rows with its SQL's in DuckDB."""

from __future__ import annotations

import decimal
import glob
import math
from collections import Counter
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = Path(path).stem
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def compare(df, sql: str, sf_dir: str) -> list[str]:
    """What differs; empty if nothing does."""
    names, theirs = duck_rows(sql, sf_dir)
    mine = df.collect()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    order = sorted(names)
    at = [names.index(c) for c in order]
    a = Counter(tuple(_plain(r[c]) for c in order) for r in mine)
    b = Counter(tuple(_plain(r[i]) for i in at) for r in theirs)
    out = [] if len(mine) == len(theirs) else [f"{len(mine)} rows against {len(theirs)}"]
    if a != b:
        out.append(f"only here {list((a - b).items())[:3]}, only there {list((b - a).items())[:3]}")
    return out
