"""The registry upsert against a database that upserts row by row, and keyed texts of any length."""

from __future__ import annotations

import random
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.operators import identity

COLUMNS = "id string, dir_name string, doi string, pmid string, publication_number string, note string"


def _replay(registry, incoming):
    """One row after the other into SQLite, whose unique indexes decide."""
    db = sqlite3.connect(":memory:")
    db.execute("create table r (id text primary key, dir_name text not null unique, doi text, pmid text, publication_number text, note text)")
    for key in ("doi", "pmid", "publication_number"):
        db.execute(f"create unique index u_{key} on r({key}) where {key} is not null and {key} <> ''")
    for row in [*registry, *[r[:-1] for r in sorted(incoming, key=lambda r: (r[-1], r[0]))]]:
        row = list(row)
        while True:
            try:
                db.execute("insert into r values (?,?,?,?,?,?) on conflict(id) do update set dir_name = excluded.dir_name, doi = excluded.doi, pmid = excluded.pmid, publication_number = excluded.publication_number, note = excluded.note", row)
            except sqlite3.IntegrityError as e:
                at = {"r.pmid": 3, "r.publication_number": 4}.get(str(e).rsplit(" ", 1)[-1])
                if at and row[at]:
                    row[at] = ""
                    continue
            break
    return sorted((*r[:3], r[3] or "", r[4] or "", r[5]) for r in db.execute("select * from r"))


@pytest.mark.parametrize("seed", range(4))
def test_upserts_equal_a_replay(spark, seed):
    rng = random.Random(seed)
    pick = lambda kind, n: rng.choice([None, "", *[f"{kind}{i}" for i in range(n)]])
    names = [f"d{i}" for i in range(14)]
    registry = [(f"i{i}", names[i], f"o{i}", f"p{i}" if i % 2 else "", f"q{i}", "old") for i in range(6)]
    incoming = [(f"i{rng.randrange(12)}", rng.choice([None, *names]) if rng.random() < 0.3 else f"own{rng.randrange(40)}", pick("o", 9), pick("p", 5), pick("q", 4), f"n{k}", k // 2) for k in range(160)]
    incoming = list({(r[0], r[-1]): r for r in incoming}.values())
    got = identity.upsert_registry(spark.createDataFrame(registry, COLUMNS), spark.createDataFrame(incoming, COLUMNS + ", pos long").repartition(5))
    assert sorted((*r[:3], r[3] or "", r[4] or "", r[5]) for r in map(tuple, got.collect())) == _replay(registry, incoming)


def test_keys_are_given_up_and_taken(spark):
    def run(registry, incoming):
        kind = "id long, pmid string"
        got = identity.upsert_registry(spark.createDataFrame(registry, kind), spark.createDataFrame(incoming, kind + ", pos long"))
        return sorted(map(tuple, got.collect()))

    assert run([(1, "K")], [(2, "K", 0), (1, "K", 1)]) == [(1, "K"), (2, "")]
    assert run([], [(1, "K", 0), (2, "K", 1), (1, "K", 2)]) == [(1, "K"), (2, "")]
    assert run([(1, "K")], [(1, "L", 0), (2, "K", 1), (3, "L", 2), (1, "K", 3), (3, "L", 4)]) == [(1, ""), (2, "K"), (3, "L")]
    assert run([(1, "K")], []) == [(1, "K")] and run([], []) == []


def test_a_chain_of_skipped_rows(spark):
    """Whether each row is stored hangs on the one before it."""
    n = 7
    registry = [(f"i{k}", f"d{k}", "", "", "", "old") for k in range(n)]
    incoming = [(f"i{k}", f"d{k + 1}", "", "", "", "new", n - k) for k in range(n)]  # the last moves first, so all move
    got = identity.upsert_registry(spark.createDataFrame(registry, COLUMNS), spark.createDataFrame(incoming, COLUMNS + ", pos long"))
    assert {r.note for r in got.collect()} == {"new"}
    blocked = [*incoming, ("x", f"d{n}", "", "", "", "first", -1)]
    got = identity.upsert_registry(spark.createDataFrame(registry, COLUMNS), spark.createDataFrame(blocked, COLUMNS + ", pos long"))
    assert sorted(r.note for r in got.collect()) == ["first", *["old"] * n]


def _seconds(spark, text, column):
    df = spark.createDataFrame([(text,)], "t string").select(F.size(column("t")).alias("n"))
    df.collect()
    began = time.time()
    return df.first().n, time.time() - began


def test_texts_of_many_citations_and_sentences_are_linear(spark):
    cites = " ".join(f"Name{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)} et al. ({1900 + i % 100}) said." for i in range(20_000))
    n, took = _seconds(spark, cites, X.citations)
    assert n >= 17_000 and took < 10
    half, before = _seconds(spark, cites[: len(cites) // 4], X.citations)
    assert n > 3 * half and took < 12 * before + 1
    signals = " ".join(f"Group {i} grew by {i} percent." for i in range(20_000))
    n, took = _seconds(spark, signals, lambda c: X.quantitative_signals(c, 30_000))
    assert n == 20_000 and took < 10


def test_first_of_each_keeps_order(spark):
    df = spark.createDataFrame([(["b", "A", "a", "B", "c", "b"],), ([],), (["x"],), (None,), (["x", "X"],)], "v array<string>")
    assert [r.g for r in df.select(X.first_of_each(F.col("v"), F.lower).alias("g")).collect()] == [["b", "A", "c"], [], ["x"], None, ["x"]]
