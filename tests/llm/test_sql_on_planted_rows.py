"""Registered queries against their SQL on tables with planted copies and odd rows."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

import compare
from paysegments.llm import oracles, pq_dedup, queries
from samples import DOCUMENTS, odd_rows, passage


def against_sql(spark, folder, name, table, df):
    df.write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    found = queries.queries()[name](spark, str(folder))
    assert compare.differences(found, con, oracles.oracle_sql()[name]) is None
    return found


def planted():
    """Vectors with near copies, chains, copies under other labels, and rows that take no part."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, queries.DIMENSIONS))
    rows = [(i, [float(x) for x in v], i % 7) for i, v in enumerate(base)]
    for i in range(0, 120, 3):
        label = i % 7
        # a chain of small steps: its ends may be too far from each other to be linked
        step = base[i]
        for j in range(4):
            step = step + rng.normal(size=len(step)) * 0.12
            rows.append((1000 + 10 * i + j, [float(x) for x in step], label))
        rows.append((5000 + i, [float(x) for x in 3 * base[i]], label))
        rows.append((6000 + i, [float(x) for x in base[i]], label + 1))
    zero, some = [0.0] * queries.DIMENSIONS, [1.0] * queries.DIMENSIONS
    odd = [None, zero, [None, *some[1:]], [float("nan"), *some[1:]], [float("inf"), *some[1:]], []]
    rows += [(8000 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(9000, some, None), (9001, some, None), (9002, some, 3), (9003, some, 3)]
    return rows


@pytest.mark.parametrize("per_list", [8192, 25])
def test_vectors_with_planted_copies(spark, tmp_path, monkeypatch, per_list):
    monkeypatch.setattr(pq_dedup, "PER_LIST", per_list)
    rows = spark.createDataFrame(planted(), "vec_id long, embedding array<float>, label int").repartition(3)
    found = against_sql(spark, tmp_path, "op9_pq_dedup", "embeddings", rows)
    assert found.where("n_links > 1").count() > 100
    assert found.where("NOT kept").count() >= 40


def test_vectors_of_an_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    against_sql(spark, tmp_path, "op9_pq_dedup", "embeddings", rows)


def test_passages_of_odd_rows(spark, tmp_path):
    shared = passage(900_000, 50)
    rows = odd_rows() + [
        (100 + i, passage(2_000_000 + 1000 * i, 7 * i) + " " + shared + " " + passage(3_000_000 + 1000 * i, 3 * i), "en", "z", 1)
        for i in range(40)
    ]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    found = against_sql(spark, tmp_path, "op2_substring_dedup", "documents", docs)
    assert found.where("doc_id >= 100 AND n_removed = 50").count() == 40


def test_passages_of_an_empty_table(spark, tmp_path):
    against_sql(spark, tmp_path, "op2_substring_dedup", "documents", spark.createDataFrame([], DOCUMENTS))
