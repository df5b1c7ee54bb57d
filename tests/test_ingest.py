"""Ingest decisions against a replay record by record, whole and as a stream in any split."""

from __future__ import annotations

import random

import pytest

from sparquill.operators import identity
from sparquill.streaming import incremental as inc

SCHEMA = "pos int, doi string, pmid string, publication_number string, title string, paper_type string"
LIBRARY = [("old", "10.1/d0", "", ""), ("older", "", "9", "")]


def records(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    pick = lambda names: r.choice([*names, "", None])
    return [(i, pick([f"10.1/D{k}" for k in range(9)]), pick([str(k) for k in range(5, 14)]), pick(["cn1", "CN1 ", "cn2", "cn3", "cn4"]), r.choice(["t", "t", "t", " ", None]), r.choice(["x", "book", None])) for i in range(n)]


def replay(rows: list[tuple]) -> dict[int, tuple]:
    """One by one, with a dictionary of what each identifier belongs to."""
    owner: dict[tuple, str | None] = {}
    for of, doi, pmid, number in LIBRARY:
        owner |= {(k, v.lower()): of for k, v in enumerate((doi, pmid, number)) if v}
    found = {}
    for pos, doi, pmid, number, title, kind in sorted(rows):
        keys = [(k, (v or "").strip().lower()) for k, v in enumerate((doi, pmid, number)) if (v or "").strip()]
        met = [owner[k] for k in keys if k in owner]
        if met:
            of = next((m for m in met if m), None)
            found[pos] = ("duplicate", "in_library" if of else "in_batch", of)
        elif not (title or "").strip():
            found[pos] = ("pending", "no_title", None)
        elif not keys and kind != "book":
            found[pos] = ("pending", "no_identifier", None)
        else:
            found[pos] = ("ingested", None, None)
            owner |= dict.fromkeys(keys)
    return found


@pytest.fixture(scope="module")
def library(spark):
    return spark.createDataFrame(LIBRARY, "id string, doi string, pmid string, publication_number string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decisions_equal_a_replay(spark, library, seed):
    rows = records(seed, 60)
    want = replay(rows)
    got = {r.pos: (r.status, r.issue, r.duplicate_of) for r in identity.ingest_decision(spark.createDataFrame(rows, SCHEMA), library).collect()}
    assert got == want
    assert {s for s, _, _ in want.values()} == {"duplicate", "pending", "ingested"}


def test_a_record_that_is_not_ingested_holds_nothing(spark, library):
    rows = [(1, "10.1/a", "", "", "t", "x"), (2, "10.1/a", "77", "", "t", "x"), (3, "", "77", "", "t", "x"), (4, "10.1/n", "", "", "", "x"), (5, "10.1/n", "", "", "t", "x")]
    got = {r.pos: r.status for r in identity.ingest_decision(spark.createDataFrame(rows, SCHEMA), library).collect()}
    assert got == {1: "ingested", 2: "duplicate", 3: "ingested", 4: "pending", 5: "ingested"}


def test_repeated_rows_clashing_columns_and_an_empty_table(spark, library):
    rows = spark.createDataFrame([(1, "10.1/a", "", "", "t", "x", "k"), (1, "10.1/a", "", "", "t", "x", "k"), (None, "10.1/d0", "", "", "t", "x", "k"), (None, "10.1/z", "", "", "t", "x", "k")], SCHEMA + ", kind string")
    got = identity.ingest_decision(rows, library)
    assert sorted((r.pos or 0, r.doi, r.status, r.kind) for r in got.collect()) == [(0, "10.1/d0", "duplicate", "k"), (0, "10.1/z", "ingested", "k"), (1, "10.1/a", "ingested", "k"), (1, "10.1/a", "ingested", "k")]
    assert identity.ingest_decision(rows.limit(0), library).count() == 0


@pytest.mark.parametrize("cuts", [(20,), (7, 8, 31)])
def test_a_stream_decides_as_the_whole_in_any_split(spark, library, tmp_path, cuts):
    rows = records(4, 45)
    src, ok, no = (f"file://{tmp_path}/{n}" for n in ("in", "ok", "no"))
    for low, high in zip((0, *cuts), (*cuts, len(rows)), strict=True):
        spark.createDataFrame(rows[low:high], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        inc.ingest_stream(spark.readStream.schema(SCHEMA).parquet(src), library, ok, no, f"file://{tmp_path}/ck", buckets=4).awaitTermination()
    want = replay(rows)
    assert sorted(r.pos for r in spark.read.parquet(ok).collect()) == sorted(p for p, w in want.items() if w[0] == "ingested")
    assert {r.pos: (r.status, r.issue, r.duplicate_of) for r in spark.read.parquet(no).collect()} == {p: w for p, w in want.items() if w[0] != "ingested"}


def test_a_batch_that_runs_again_changes_nothing(spark, library, tmp_path):
    rows = records(5, 30)
    src, ok, no = (f"file://{tmp_path}/{n}" for n in ("in", "ok", "no"))
    run = lambda: inc.ingest_stream(spark.readStream.schema(SCHEMA).parquet(src), library, ok, no, f"file://{tmp_path}/ck").awaitTermination()
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(src)
    run()
    for name in (tmp_path / "ck" / "commits").iterdir():  # as if the run was lost after it wrote, before it said so
        name.unlink()
    run()
    want = replay(rows)
    assert sorted(r.pos for r in spark.read.parquet(ok).collect()) == sorted(p for p, w in want.items() if w[0] == "ingested")
    assert spark.read.parquet(no).count() == sum(w[0] != "ingested" for w in want.values())
