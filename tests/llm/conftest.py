from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from samples import CLASHES, CLASHING, DOCUMENTS, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with further columns whose names operators use inside."""
    rows = [(*r, *CLASHING) for r in odd_rows()]
    return spark.createDataFrame(rows, f"{DOCUMENTS}, {CLASHES}").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
