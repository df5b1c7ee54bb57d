"""Paged bibliographic services as Spark data sources.

The reader asks a `fetch(cursor)` function for pages; without a network a folder of
saved pages stands in for it. `spark.dataSource.register(PagedWorks)`, then
`spark.read.format("paged_works").option("path", folder).load()`.
"""

from __future__ import annotations

import json
import operator
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

# Tries and the first pause of the backoff.
TRIES, PAUSE = 3, 1.0

#: Columns that the service compares, and how it writes what a filter asks.
COMPARED = ("publication_year", "cited_by_count")
_ASKS: dict[type, tuple[str, int]] = {EqualTo: ("", 0), GreaterThan: (">", 0), GreaterThanOrEqual: (">", -1), LessThan: ("<", 0), LessThanOrEqual: ("<", 1)}
_TESTS = {"": operator.eq, ">": operator.gt, "<": operator.lt}
Condition = tuple[str, str, int]


def with_retries(call: Callable[[], dict], tries: int = TRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The call's result; failed calls are repeated after a pause that doubles, the last failure is raised."""
    for i in range(tries):
        try:
            return call()
        except Exception:
            if i == tries - 1:
                raise
            sleep(pause * 2**i)
    raise AssertionError


def pages(fetch: Callable[[str], dict], limit: int | None = None, **retry) -> Iterator[dict]:
    """Results of all pages, following cursors, at most `limit`."""
    cursor, given = "*", 0
    while cursor:
        page = with_retries(lambda c=cursor: fetch(c), **retry)
        for work in page.get("results", []):
            if limit is not None and given >= limit:
                return
            given += 1
            yield work
        cursor = (page.get("meta") or {}).get("next_cursor") or ""


def condition(f: Filter) -> Condition | None:
    """A filter as (column, sign, number), or None where the service can't compare."""
    if type(f) not in _ASKS or f.attribute not in [(c,) for c in COMPARED] or not isinstance(f.value, int):
        return None
    sign, more = _ASKS[type(f)]
    return f.attribute[0], sign, f.value + more


def asked(conditions: list[Condition]) -> str:
    """Conditions as the service's filter string."""
    return ",".join(f"{column}:{sign}{number}" for column, sign, number in conditions)


def satisfies(work: dict, conditions: list[Condition]) -> bool:
    """Whether a work meets all of them; one that lacks the number doesn't."""
    return all(isinstance(work.get(c), int) and _TESTS[sign](work[c], number) for c, sign, number in conditions)


class PagedWorks(DataSource):
    """Saved pages, a file each, named page-<n>.json; one partition per file.

    Option limit: at most so many works in all, in order of the files' names; conditions come
    after it. Option pushdown: without a limit, conditions on year and citations are met by the
    reader; Spark wants spark.sql.python.filterPushdown.enabled for it.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_works"

    def schema(self) -> str:
        return "id string, doi string, title string, publication_year int, cited_by_count long, abstract_inverted_index string"

    def reader(self, schema) -> DataSourceReader:
        return (_FilteredPages if self.options.get("pushdown", "") == "true" else _SavedPages)(self.options)


class _SavedPages(DataSourceReader):
    def __init__(self, options):
        self.folder, self.limit = options.get("path", ""), int(options.get("limit", "0"))
        self.conditions: list[Condition] = []

    def partitions(self) -> list[InputPartition]:
        files = [str(p) for p in sorted(Path(self.folder).glob("page-*.json"))]
        if not self.limit:
            return [InputPartition((f, None)) for f in files]
        # pages are counted until the limit is met, so that it holds for all of them together
        found, left = [], self.limit
        for f in files:
            take = min(left, len(_results(f)))
            if take:
                found.append(InputPartition((f, take)))
            left -= take
            if not left:
                break
        return found

    def read(self, partition: InputPartition):
        path, most = partition.value
        for work in _results(path)[:most]:
            if not satisfies(work, self.conditions):
                continue
            inverted = work.get("abstract_inverted_index")
            yield work.get("id"), work.get("doi"), work.get("title"), work.get("publication_year"), work.get("cited_by_count"), json.dumps(inverted) if inverted else None


class _FilteredPages(_SavedPages):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over what can be compared and gives back the rest."""
        for f in filters:
            if self.limit or (c := condition(f)) is None:
                yield f
            else:
                self.conditions.append(c)

    @property
    def asked(self) -> str:
        """What a service is asked for."""
        return asked(self.conditions)


def _results(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        return json.load(f).get("results", [])
