from __future__ import annotations

import pytest

LONG = "la maison ouverte " * 20_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and very long texts, repeated rows, and columns named like results."""
    rows = [
        (1, "the cat sat on the mat and looked at the small red door", "en"),
        (2, None, "en"),
        (3, "", None),
        (4, LONG, "fr"),
        (5, "the cat sat on the mat and looked at the small red door", "en"),
        (5, "the cat sat on the mat and looked at the small red door", "en"),
        (None, "ein kleiner Hund läuft über die Straße <|endoftext|> 你好 x", "de"),
        (7, "   \n\t ", "de"),
        (8, "1234 5678 !!", None),
        (9, "one", "en"),
    ]
    made = [(*r, "n", 7, 1.0, "x", 3) for r in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, fp string, n_tokens int, score double, fingerprint string, k int")


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.where("false")
