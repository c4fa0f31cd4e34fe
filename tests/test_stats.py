from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from build import CFG, by_company
from paysegments.operators import stats
from paysegments.plans.features import FEATURES


def frame(spark, **cols):
    n = len(next(iter(cols.values())))
    rows = [(i, *(None if v[i] is None else float(v[i]) for v in cols.values())) for i in range(n)]
    schema = "company_id bigint, " + ", ".join(f"{c} double" for c in cols)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def varied(spark):
    rng = np.random.default_rng(3)
    n = 5001
    cols = {
        "wide": rng.lognormal(3, 4, n),
        "heaped": np.where(rng.random(n) < 0.4, 0.0, rng.random(n)),
        "few": rng.integers(0, 5, n),
        "constant": np.ones(n),
        "close": rng.normal(size=n) * 1e-9 + 1e6,
        "huge": rng.uniform(-1.7, 1.7, n) * 1e308,
        "signed": rng.normal(size=n),
    }
    pdf = pd.DataFrame({c: np.asarray(v, dtype=float) for c, v in cols.items()})
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


@pytest.mark.parametrize("accuracy", [100_000, 10_000, 300, 20])
def test_quantiles_do_not_depend_on_the_sketch(varied, accuracy):
    pdf, df = varied
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    found = stats.quantiles(df, list(pdf), probs, accuracy=accuracy)
    for c in pdf:
        lo, hi = (np.quantile(pdf[c], probs, method=m) for m in ("lower", "higher"))
        mixed = np.quantile(pdf[c] / 4, probs) * 4
        assert all(lo <= found[c]) and all(found[c] <= hi)
        np.testing.assert_allclose(found[c], mixed, rtol=1e-12)


@pytest.mark.parametrize("accuracy", [10_000, 3])
def test_quantiles_of_short_and_empty_columns(spark, accuracy):
    df = frame(spark, a=[3, None, 1, None], b=[None] * 4, c=[5, 5, 5, 7])
    found = stats.quantiles(df, ["a", "b", "c"], (0.25, 0.5), accuracy=accuracy)
    assert found == {"a": [1.5, 2.0], "b": [None, None], "c": [5.0, 5.0]}


def test_profile(spark):
    df = frame(spark, a=[1, 2, 3, 10], b=[None, 4, 4, None])
    rows = {r["feature"]: tuple(r)[1:] for r in stats.profile(df, ["a", "b"]).collect()}
    assert rows["a"] == (4, 4.0, pytest.approx(np.std([1, 2, 3, 10], ddof=1)), 1, 1.75, 2.5, 4.75, 10)
    assert rows["b"] == (2, 4.0, 0.0, 4, 4, 4, 4, 4)


def test_scaled_middle_is_zero_and_range_one(varied):
    pdf, df = varied
    cols = ["wide", "few", "signed"]
    scaled = stats.robust_scale(df, cols)
    after = stats.quantiles(scaled, cols)
    for c in cols:
        assert after[c][1] == 0 and after[c][2] - after[c][0] == pytest.approx(1)


def test_no_spread_only_centres(spark):
    heaped = [0] * 8 + [3, 9]
    df = frame(spark, constant=[4] * 10, heaped=heaped)
    scaled = stats.robust_scale(df, ["constant", "heaped"])
    assert by_company(scaled, "constant", "heaped") == {
        i: (0.0, float(v)) for i, v in enumerate(heaped)
    }


def test_transform(spark):
    df = frame(spark, **dict(zip(FEATURES, ([1, 390, 400], [0, 1, 2], [0, 1, 2], [9, 0, 0], [0.5, 0, 1]))))
    found = by_company(stats.transform(df, CFG), *FEATURES)
    assert found[0] == pytest.approx((math.log(389), 0, 0, math.log(10), 0.5))
    assert found[1][0] is None and found[2][0] is None
    linear = by_company(stats.transform(df, CFG, log_first=False), FEATURES[0])
    assert linear == {0: 389, 1: 0, 2: -10}
    with pytest.raises(ValueError, match="of 3 rows, days_since_first_tx is missing or not finite in 2"):
        stats.robust_scale(stats.transform(df, CFG), FEATURES)


def test_head_and_shape(spark):
    df = frame(spark, a=range(9)).orderBy("company_id", ascending=False)
    assert [r["company_id"] for r in stats.head(df).collect()] == [0, 1, 2, 3, 4]
    assert stats.shape(df).collect() == [(9, 2)]


@pytest.mark.parametrize("odd", [math.nan, math.inf, -math.inf])
def test_odd_values_are_refused(spark, odd):
    df = frame(spark, a=[1, 2, odd], b=[1, 2, 3])
    with pytest.raises(ValueError, match="a has 1 values"):
        stats.profile(df, ["a", "b"])
    with pytest.raises(ValueError, match="of 3 rows, a is missing or not finite in 1"):
        stats.robust_scale(df, ["a", "b"])


def test_quantiles_take_two_jobs(spark):
    context = spark.sparkContext
    for n in (10, 1000, 100_000):
        df = spark.range(n).select((F.xxhash64("id") % 1000).cast("double").alias("a"), F.sqrt("id").alias("b")).cache()
        df.count()
        context.setJobGroup(f"quantiles {n}", "")
        found = stats.quantiles(df, ["a", "b"], (0.01, 0.5, 1.0))
        jobs = context.statusTracker().getJobIdsForGroup(f"quantiles {n}")
        context.setLocalProperty("spark.jobGroup.id", None)
        values = df.toPandas()
        for c in ("a", "b"):
            assert found[c] == pytest.approx(values[c].quantile([0.01, 0.5, 1.0]).tolist(), abs=1e-12)
        # a job of two shuffles is several for the scheduler, as its plan adapts
        assert len(jobs) <= 8
