from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
for p in (ROOT, str(Path(__file__).resolve().parent)):
    if p not in sys.path:
        sys.path.insert(0, p)
os.environ.setdefault("SPARQUILL_DRIVER_MEMORY", "6g")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sparquill.session import local_session, ship

    s = local_session(4, 4, "file://" + str(tmp_path_factory.mktemp("shared")))
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
