"""Year ranges: 2023, 2020-2024, 2020-, -2024."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_year_range(text: str) -> tuple[int | None, int | None]:
    """(first, last), either open; anything else raises ValueError."""
    m = re.fullmatch(r"\s*(\d{4})?\s*(-)?\s*(\d{4})?\s*", text or "")
    if not m or not (m[1] or m[3]) or (m[3] and not m[2]):
        raise ValueError(f"not a year or range of years: {text!r}")
    if not m[2]:
        return int(m[1]), int(m[1])
    return (int(m[1]) if m[1] else None), (int(m[3]) if m[3] else None)


def text_year_filter(year: Column, text: str) -> Column:
    """On a year kept as text: a missing year is '', below any upper bound and above no lower one."""
    first, last = parse_year_range(text)
    y = F.coalesce(year.cast("string"), F.lit(""))
    kept = F.lit(True)
    if first is not None:
        kept = kept & (y >= str(first))
    if last is not None:
        kept = kept & (y <= str(last))
    return kept


def export_year_filter(year: Column, text: str) -> Column:
    """On a numeric year: a missing one fails every bound."""
    first, last = parse_year_range(text)
    kept = F.lit(True)
    if first is not None:
        kept = kept & (F.coalesce(year, F.lit(0)) >= first)
    if last is not None:
        kept = kept & (F.coalesce(year, F.lit(9999)) <= last)
    return kept
