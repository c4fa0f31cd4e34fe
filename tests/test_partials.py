"""Stored months against the same figures from one read of all payments."""

from __future__ import annotations

from dataclasses import replace
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from build import CFG, pay, payments, segments
from paysegments.operators import activity
from paysegments.plans.partials import MonthlyPartials, next_month
from paysegments.sources import star

SMALL = "/root/testdata/sf0.001"
VALUES = ["sum_monthly_payments", "count_monthly_payments"]


def rows(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def day(text):
    return date.fromisoformat(text)


def same(months, p, s):
    """Everything that months are merged into, against the plain operators."""
    for by_type in (False, True):
        keys = ["company_id", "month", "segment"] + ["payment_type"] * by_type
        found = months.monthly(p, s, by_type)
        plain = activity.monthly_activity(p, s, months.cfg, by_type)
        for df, other in ((found, plain), (plain, found)):
            assert set(keys + VALUES) <= set(df.columns) and df.count() == other.count()
        cast = [F.col(c).cast("string").alias(c) for c in VALUES]
        assert rows(found, *keys, *cast) == rows(plain, *keys, *cast)
    recency = activity.recency(p, s, months.cfg)
    assert rows(months.recency(months.monthly(p, s)), *recency.columns) == rows(recency, *recency.columns)


def test_next_month():
    assert next_month(date(2023, 12, 31)) == date(2024, 1, 1)
    assert next_month(date(2024, 1, 1)) == date(2024, 2, 1)


WINDOWS = [
    (date(2000, 9, 1), date(2001, 8, 31)),
    (date(2000, 9, 15), date(2001, 8, 30)),
    (date(2001, 2, 3), date(2001, 2, 20)),
    (date(1990, 1, 1), date(1990, 12, 31)),
    (None, date(2001, 8, 31)),
    (None, date(2001, 3, 5)),
]


@pytest.mark.parametrize("window", WINDOWS, ids=str)
def test_any_window(spark, tmp_path, window):
    p, s = star.payments(spark, SMALL), star.segments(spark, SMALL)
    cfg = replace(star.STAR, window_start=window[0], window_end=window[1])
    months = MonthlyPartials(spark, str(tmp_path), cfg)
    same(months, p, s)  # nothing stored
    months.refresh(p, day("2000-11-01"), day("2001-04-09"))
    assert months.stored() == (day("2000-11-01"), day("2001-04-01"))
    same(months, p, s)
    months.refresh(p, day("2001-04-01"), day("2001-07-01"))
    months.refresh(p, day("2000-08-01"), day("2000-10-01"))
    assert months.stored() == (day("2000-08-01"), day("2001-07-01"))
    same(months, p, s)


def files(months):
    return {str(f.relative_to(months.path)) for f in Path(months.path).rglob("*.parquet")}


def test_new_month_reads_that_month_only(spark, tmp_path):
    old = [pay(1, "2024-05-02", amount=5), pay(1, "2024-05-31", amount=6), pay(2, "2024-04-30")]
    s = segments(spark, 1, 2)
    months = MonthlyPartials(spark, str(tmp_path), CFG)
    months.refresh(payments(spark, *old), day("2023-09-01"), day("2024-05-01"))
    before = files(months)
    # the May that this input shows must not be seen
    new = payments(spark, pay(1, "2024-05-03", amount=1000), pay(1, "2024-06-01", amount=7))
    months.refresh(new, day("2024-06-01"), day("2024-06-30"))
    assert before < files(months)
    assert all(name.startswith("month=2024-06-01") for name in files(months) - before)
    found = months.monthly(new, s).groupBy("company_id").agg(F.sum("sum_monthly_payments").cast("int").alias("n"))
    assert rows(found, "company_id", "n") == ["Row(company_id=1, n=18)", "Row(company_id=2, n=10)"]


def test_whole_months_are_not_read_from_payments(spark, tmp_path):
    p, s = payments(spark, pay(1, "2024-05-02")), segments(spark, 1)
    path = str(tmp_path / "payments")
    p.write.parquet(path)
    p = spark.read.schema(p.schema).parquet(path)
    months = MonthlyPartials(spark, str(tmp_path / "months"), CFG)
    months.refresh(p, CFG.window_start, CFG.window_end)
    read = months.monthly(p, s).inputFiles()
    assert read and not any(path in name for name in read)
    first = MonthlyPartials(spark, str(tmp_path / "months"), replace(CFG, window_start=date(2023, 8, 31)))
    assert any(path in name for name in first.monthly(p, s).inputFiles())


def test_months_of_the_window_only_are_scanned(spark, tmp_path):
    p, s = payments(spark, pay(1, "2024-05-02"), pay(1, "2023-10-02")), segments(spark, 1)
    months = MonthlyPartials(spark, str(tmp_path), CFG)
    months.refresh(p, CFG.window_start, CFG.window_end)
    month = replace(CFG, window_start=date(2024, 5, 1), window_end=date(2024, 5, 31))
    plan = MonthlyPartials(spark, str(tmp_path), month).monthly(p, s)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2024-05-01" in plan


def test_a_month_that_loses_its_payments(spark, tmp_path):
    s = segments(spark, 1)
    months = MonthlyPartials(spark, str(tmp_path), CFG)
    months.refresh(payments(spark, pay(1, "2024-05-02"), pay(1, "2024-06-02")), CFG.window_start, CFG.window_end)
    rest = payments(spark, pay(1, "2024-06-02"), pay(1, "2024-05-02", status="Refunded"))
    months.refresh(rest, day("2024-05-01"), day("2024-05-01"))
    same(months, rest, s)
    assert months.stored() == (day("2023-09-01"), day("2024-08-01"))


def test_nulls_repeats_and_types(spark, tmp_path):
    p = payments(
        spark,
        pay(1, "2024-05-02", payment_id=1, payment_type="Rent"),
        pay(1, "2024-05-09", payment_id=1, payment_type="GST"),
        pay(1, "2024-06-09", payment_id=1, payment_type=None, amount=None),
        pay(1, None),
        pay(None, "2024-05-02"),
        pay(2, "2024-05-02", payment_id=None),
        pay(2, "2024-05-02", payment_id=None),
        pay(3, "2024-05-02", locale_id=None),
    )
    s = segments(spark, 1, 1, 2, (3, "other"))
    months = MonthlyPartials(spark, str(tmp_path), CFG)
    months.refresh(p, day("2024-05-01"), day("2024-06-01"))
    same(months, p, s)


def test_empty_payments(spark, tmp_path):
    p, s = payments(spark), segments(spark, 1)
    months = MonthlyPartials(spark, str(tmp_path), CFG)
    months.refresh(p, CFG.window_start, CFG.window_end)
    assert months.monthly(p, s).count() == 0
    assert months.stored() == (day("2023-09-01"), day("2024-08-01"))


def test_gaps_and_rules(spark, tmp_path):
    p = payments(spark, pay(1, "2024-05-02"))
    months = MonthlyPartials(spark, str(tmp_path), CFG)
    months.refresh(p, day("2024-03-01"), day("2024-04-01"))
    with pytest.raises(ValueError, match="gap"):
        months.refresh(p, day("2024-06-01"), day("2024-06-01"))
    with pytest.raises(ValueError, match="gap"):
        months.refresh(p, day("2024-01-01"), day("2024-01-31"))
    with pytest.raises(ValueError, match="before"):
        months.refresh(p, day("2024-05-01"), day("2024-04-01"))
    other = MonthlyPartials(spark, str(tmp_path), replace(CFG, locale=2))
    assert other.stored() is None
    turned = MonthlyPartials(spark, str(tmp_path), replace(CFG, excluded_statuses=CFG.excluded_statuses[::-1]))
    assert turned.stored() == months.stored()
