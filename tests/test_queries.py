"""Every registered query against its SQL counterpart, on whole tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import compare
from paysegments.operators import medoids
from paysegments.plans import segmentation
from paysegments.plans.features import FEATURES
from paysegments.queries import queries
from paysegments.sources.star import STAR, payments, segments

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


def test_every_query_has_sql():
    assert set(queries()) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", list(queries()))
def test_matches_sql(spark, con, name):
    df = queries()[name](spark, SMALL)
    assert compare.differences(df, con, entry_points.oracle_sql()[name]) is None


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["company_id", *FEATURES, "cluster"]
    assert df.count() == 56


# Worked out beforehand with an independent exact fit on the same mapping.
PAM_LOSS, PAM_SIZES = 614.99, [143, 129, 133, 121]
ELBOW = [853.6, 715.0, 669.6, 637.7, 602.3, 592.6, 565.9, 548.8, 539.7, 523.3]


@pytest.fixture(scope="module")
def scaled(spark):
    return segmentation.scaled_features(
        payments(spark, MIDDLE), segments(spark, MIDDLE), STAR
    )


@pytest.mark.parametrize("sizes", [{}, {"cells": 40, "batch": 60}])
def test_known_fit(scaled, sizes):
    chosen = medoids.kmedoids(scaled, FEATURES, 4, "pam", **sizes)
    labelled = medoids.assign(scaled, FEATURES, chosen)
    assert round(medoids.inertia(labelled).first()[0], 2) == PAM_LOSS
    sizes_found = labelled.groupBy("cluster").agg(F.count("*")).orderBy("cluster").collect()
    assert [r[1] for r in sizes_found] == PAM_SIZES


def test_known_elbow(scaled):
    rows = medoids.elbow(scaled, FEATURES, range(1, 11)).orderBy("k").collect()
    assert [round(r["loss"], 1) for r in rows] == ELBOW
