"""Queries on workers that do not have this package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1")
    .config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", sys.argv[2])
    .getOrCreate()
)
sys.path.insert(0, sys.argv[1])
from paysegments.llm import queries
from paysegments.queries import queries as core
known = queries.queries() | core()
for name in sys.argv[3:]:
    print(name, known[name](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize(
    "names",
    [
        ("op2_substring_dedup", "op3_bpe", "op4_ann", "op5_simhash"),
        ("op6_token_counts", "op8_language_id", "op9_pq_dedup"),
        ("op12_conversation_repair", "op13_document_fingerprints", "company_clusters"),
    ],
)
def test_workers_without_the_package(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(ROOT), str(tmp_path / "warehouse"), *names],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600,
    )
    assert found.returncode == 0, found.stderr[-3000:]
    assert [line.split()[0] for line in found.stdout.splitlines()] == list(names)
