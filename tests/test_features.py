"""The rules of the feature queries, on rows worked out by hand."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

import pytest

from build import CFG, OWN, by_company, pay, payments, segments
from paysegments.functions.dates import month_start, months_between_starts
from paysegments.operators import activity, filters, shares
from paysegments.plans import features
from pyspark.sql import functions as F

ALL = CFG.all_history()


def rollup(p, s, cfg=CFG):
    return activity.activity_rollup(activity.monthly_activity(p, s, cfg))


def test_eligibility_drops_null_and_excluded(spark):
    p = payments(
        spark,
        pay(1, "2024-05-01"),
        pay(2, "2024-05-01", status="Refunded"),
        pay(3, "2024-05-01", status=None),
        pay(4, "2024-05-01", user_type="guest"),
        pay(5, "2024-05-01", user_type="consumer"),
        pay(6, "2024-05-01", user_type=None),
        pay(7, "2024-05-01", locale_id=2),
        pay(8, "2024-05-01", locale_id=None),
        *[pay(9, "2024-05-01", status=st) for st in ("Payment Failed", "Cancelled", "Refunding")],
    )
    assert set(by_company(filters.eligible(p, CFG), "payment_id")) == {1, 4}


def test_window_ends_are_inclusive(spark):
    p = payments(
        spark,
        pay(1, "2023-09-01T00:00:00"),
        pay(2, "2023-08-31T23:59:59"),
        pay(3, "2024-08-31T23:59:59"),
        pay(4, "2024-09-01T00:00:00"),
        pay(5, None),
    )
    assert set(by_company(filters.in_window(p, CFG), "payment_id")) == {1, 3}
    assert set(by_company(filters.in_window(p, ALL), "payment_id")) == {1, 2, 3}


def test_recency_days(spark):
    p = payments(spark, pay(1, "2023-09-01"), pay(1, "2024-08-31T23:00:00"), pay(2, "2020-01-01"))
    s = segments(spark, 1, 2)
    days = ("days_since_first_tx", "days_since_last_tx")
    # the window spans 29 February 2024
    assert by_company(activity.recency(p, s, CFG), *days) == {1: (366, 1)}
    assert by_company(activity.recency(p, s, ALL), *days) == {1: (366, 1), 2: (1705, 1705)}


def test_months_are_counted_without_both_ends(spark):
    p = payments(
        spark,
        pay(1, "2024-01-05"),
        pay(1, "2024-01-25"),
        pay(2, "2024-01-31"),
        pay(2, "2024-02-01"),
        pay(3, "2023-11-30"),
        pay(3, "2024-02-01"),
    )
    rate = activity.frequency(rollup(p, segments(spark, 1, 2, 3)))
    found = by_company(rate, "avg_monthly_payments", "avg_monthly_payment_count")
    assert found == {1: (20.0, 2.0), 2: (20.0, 2.0), 3: (20 / 3, 2 / 3)}


def test_month_difference_of_any_months(spark):
    row = spark.sql("SELECT DATE'2023-11-30' AS a, DATE'2025-02-01' AS b").select(
        months_between_starts(month_start(F.col("a")), month_start(F.col("b")))
    )
    assert row.first()[0] == 15


def test_a_payment_seen_in_two_months_counts_twice(spark):
    p = payments(
        spark,
        pay(1, "2024-01-05", payment_id=7),
        pay(1, "2024-01-06", payment_id=7),
        pay(1, "2024-02-06", payment_id=7),
        pay(1, "2024-02-07", payment_id=None),
    )
    s = segments(spark, 1)
    assert by_company(rollup(p, s), "total_payment_count", "total_payments") == {1: (2, 40)}
    table = features.payer_features(p, s, replace(CFG, recent_since=date(2024, 1, 1)), True, True)
    assert by_company(table, "total_payment_count", "total_payments") == {1: (2, 40)}


def test_lookup_rows_may_repeat(spark):
    p = payments(spark, pay(1, "2024-07-01"), pay(2, "2024-07-01"), pay(3, "2024-07-01"))
    s = segments(spark, 1, 1, (2, "Managed"), 2, (3, "Managed"), (4, None))
    assert by_company(rollup(p, s), "total_payments") == {1: 10, 2: 10}
    assert set(by_company(features.payer_features(p, s, CFG), "days_since_last_tx")) == {1, 2}
    assert filters.with_raw_segment(p, s, CFG).groupBy("company_id").count().orderBy(
        "company_id"
    ).collect() == [(1, 2), (2, 1)]
    assert filters.with_segment(p, s).count() == 4
    assert filters.segment_payments(s, p, CFG).count() == 3


def test_shares_take_all_dates(spark):
    p = payments(
        spark,
        pay(1, "2024-07-01"),
        pay(1, "2019-07-01", schedule_type="recurring"),
        pay(1, "2030-07-01", schedule_type="recurring"),
        pay(1, None, schedule_type="recurring"),
        pay(1, "2024-07-01", schedule_type="recurring", status="Cancelled"),
    )
    s = segments(spark, 1)
    table = features.payer_features(p, s, CFG)
    assert by_company(table, "schedule_share_recurring", "days_since_first_tx") == {1: (0.75, 62)}
    mix = shares.type_shares(s, p, CFG)
    assert by_company(mix, "payment_type_share") == {1: 1.0}


def test_recent_takes_any_payment(spark):
    p = payments(
        spark,
        pay(1, "2024-01-01"),
        pay(1, "2024-07-01", status="Cancelled", user_type=None, locale_id=None),
        pay(2, "2024-01-01"),
        pay(2, "2025-01-01", schedule_type="recurring"),
        pay(3, "2024-01-01"),
        pay(3, None),
        pay(4, "2024-07-01", status="Cancelled"),
    )
    s = segments(spark, 1, 2, 3, 4)
    assert set(by_company(filters.recent_companies(p, CFG))) == {1, 2, 4}
    days = ("days_since_first_tx", "days_since_last_tx", "avg_monthly_payments")
    table = features.payer_features(p, s, CFG)
    assert by_company(table, *days) == {1: (244, 244, 10.0), 2: (244, 244, 10.0)}
    assert set(by_company(features.payer_features_all(p, s, CFG), *days)) == {1, 2, 3}
    assert set(by_company(features.amount_mix(p, s, CFG), "amount_rent")) == {1, 2}


def test_schedule_under_two_types_and_a_third_type(spark):
    p = payments(
        spark,
        pay(1, "2024-01-01", schedule_id=5),
        pay(1, "2024-01-01", schedule_id=5, schedule_type="recurring"),
        pay(1, "2024-01-01", schedule_id=6, schedule_type="on demand"),
        pay(1, "2024-01-01", schedule_id=7, schedule_type=None),
    )
    s = segments(spark, 1)
    counts = shares.schedule_distincts(p, s, CFG)
    assert {
        r["schedule_type"]: (r["count_schedule_by_type"], r["count_schedule_all"], r["count_payment_all"])
        for r in counts.collect()
    } == {"one off": (1, 3, 4), "recurring": (1, 3, 4), "on demand": (1, 3, 4), None: (1, 3, 4)}
    pivot = shares.schedule_pivot(p, s, CFG)
    found = by_company(pivot, "schedule_share_oneoff", "schedule_share_recurring")
    assert found == {1: (1 / 3, 1 / 3)}


def test_null_ids_are_not_counted(spark):
    p = payments(
        spark,
        # only NULL schedules: no share if all rows are of the type, else 0
        pay(1, "2024-01-01", schedule_id=None, schedule_type="recurring"),
        pay(2, "2024-01-01", schedule_id=None, schedule_type="recurring"),
        pay(2, "2024-01-01", schedule_id=None),
        pay(3, "2024-01-01", schedule_id=None, schedule_type="recurring"),
        pay(3, "2024-01-01", schedule_id=9),
    )
    pivot = shares.schedule_pivot(p, segments(spark, 1, 2, 3), CFG)
    assert by_company(pivot, "schedule_share_recurring", "count_schedule_recurring") == {
        1: (None, 0),
        2: (0.0, 0),
        3: (0.0, 0),
    }
    assert by_company(pivot, "payment_share_recurring") == {1: 1.0, 2: 0.5, 3: 0.5}


def pivot_from_shares(df):
    """The pivot as plain conditional maxima over the shares by type."""
    columns = []
    for kind in ("schedule", "payment"):
        for label, t in (("oneoff", "one off"), ("recurring", "recurring")):
            hit = F.col("schedule_type") == t
            columns += [
                F.max(F.when(hit, F.col(f"count_{kind}_by_type")).otherwise(0)).alias(
                    f"count_{kind}_{label}"
                ),
                F.max(F.when(hit, F.col(f"{kind}_share")).otherwise(0.0)).alias(
                    f"{kind}_share_{label}"
                ),
            ]
    return df.groupBy("company_id").agg(*columns)


@pytest.mark.parametrize("seed", range(3))
def test_pivot_equals_conditional_maxima(spark, seed):
    import random

    draw = random.Random(seed)
    rows = [
        pay(
            draw.randrange(12),
            "2024-01-01",
            schedule_id=draw.choice([None, *range(6)]),
            payment_id=draw.choice([None, *range(9)]),
            schedule_type=draw.choice(["one off", "recurring", "on demand", None]),
        )
        for _ in range(60)
    ]
    p, s = payments(spark, *rows), segments(spark, *range(12))
    plain = pivot_from_shares(shares.schedule_shares(shares.schedule_distincts(p, s, CFG)))
    pivot = shares.schedule_pivot(p, s, CFG)
    assert by_company(pivot, *plain.columns[1:]) == by_company(plain, *plain.columns[1:])


def test_amount_pivot_cells(spark):
    p = payments(
        spark,
        pay(1, "2024-07-01", amount=-5),
        pay(1, "2024-07-01", amount=8, payment_type="Payroll"),
        pay(2, "2024-07-01", amount=-5),
        pay(3, "2024-07-01", amount=4, payment_type="Gold"),
        pay(3, "2024-07-01", amount=4, payment_type=None),
        pay(3, "2024-07-02", amount=4, payment_type="Condo & MCST fees"),
    )
    mix = features.amount_mix(p, segments(spark, 1, 2, 3), CFG)
    assert len(mix.columns) == 1 + 18 + 2
    found = by_company(
        mix, "amount_rent", "amount_payroll", "amount_condo_mcst_fees", "sum_total_payments"
    )
    assert found == {1: (0, 8, 0, 3), 2: (-5, 0, 0, -5), 3: (0, 0, 4, 12)}
    assert by_company(mix, "sum_total_payment_count") == {1: 2, 2: 1, 3: 3}


def test_share_pivot_keeps_absent_types_null(spark):
    p = payments(
        spark,
        pay(1, "2024-07-01"),
        pay(1, "2024-07-01", payment_type="Payroll"),
        pay(1, "2024-07-01", payment_type="Gold"),
        pay(1, "2024-07-01", payment_type="GST", payment_id=None),
        pay(2, "2024-07-01", payment_type="Gold"),
        pay(2, "2024-07-01", payment_type=None),
        # one payment under two types
        pay(3, "2024-07-01", payment_id=77),
        pay(3, "2024-07-01", payment_id=77, payment_type="Parking"),
    )
    pivot = shares.type_share_pivot(segments(spark, 1, 2, 3), p, CFG)
    found = by_company(pivot, "share_rent", "share_payroll", "share_gst", "share_parking")
    third = 1 / 3
    assert found == {
        1: (third, third, 0.0, None),
        2: (None, None, None, None),
        3: (1.0, None, None, 1.0),
    }


def test_more_types_than_one_bit_column_holds(spark):
    types = tuple(f"T{i:03d}" for i in range(130))
    cfg = replace(CFG, payment_types=types)
    p = payments(
        spark,
        *[pay(1, "2024-07-01", payment_type=t) for t in ("T000", "T061", "T062", "T124", "T129")],
        pay(2, "2024-07-01", payment_type="other"),
    )
    pivot = shares.type_share_pivot(segments(spark, 1, 2), p, cfg)
    one, two = pivot.orderBy("company_id").collect()
    filled = {n for n in pivot.columns[1:] if one[n] is not None}
    assert filled == {"share_t000", "share_t061", "share_t062", "share_t124", "share_t129"}
    assert {one[n] for n in filled} == {0.2}
    assert all(two[n] is None for n in pivot.columns[1:])


def test_company_without_a_feature_is_left_out(spark):
    p = payments(spark, pay(1, "2024-07-01"), pay(2, "2024-07-01", status="Cancelled"))
    assert set(by_company(features.payer_features(p, segments(spark, 1, 2, 5), CFG))) == {1}


def test_fused_table_equals_operators(spark):
    import random

    draw = random.Random(7)
    rows = [
        pay(
            draw.randrange(8),
            f"2024-{draw.randrange(1, 10):02d}-{draw.randrange(1, 28):02d}",
            payment_id=draw.randrange(40),
            schedule_id=draw.randrange(15),
            schedule_type=draw.choice(["one off", "recurring"]),
            payment_type=draw.choice(["Rent", "GST", "Gold"]),
            status=draw.choice(["Success", "Success", "Cancelled"]),
            amount=draw.randrange(-5, 50),
        )
        for _ in range(150)
    ]
    p, s = payments(spark, *rows), segments(spark, *range(7), (7, "Managed"))
    parts = activity.recency(p, s, CFG).join(
        activity.frequency(rollup(p, s)), "company_id"
    )
    parts = parts.join(shares.schedule_pivot(p, s, CFG), "company_id")
    parts = filters.keep_recent(parts, p, CFG)
    cols = [*features.FEATURES, *features.TOTALS]
    table = features.payer_features(p, s, CFG, include_totals=True)
    assert by_company(table, *cols) == by_company(parts, *cols)
    monthly = activity.monthly_activity(p, s, CFG, by_type=True)
    mix = activity.type_amount_pivot(activity.type_totals(monthly), CFG)
    mix = filters.keep_recent(mix, p, CFG)
    fused = features.amount_mix(p, s, CFG)
    assert by_company(fused, *mix.columns[1:]) == by_company(mix, *mix.columns[1:])


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_small_and_large_segments_agree(spark, conf, threshold):
    conf(
        spark__sql__autoBroadcastJoinThreshold=threshold,
        spark__sql__adaptive__autoBroadcastJoinThreshold=threshold,
    )
    p = payments(
        spark,
        pay(1, "2024-07-01", amount=3),
        pay(1, "2024-06-01", schedule_type="recurring"),
        pay(2, "2024-07-01"),
    )
    s = segments(spark, 1, 1, (2, "Managed"))
    table = features.payer_features(p, s, CFG, include_type_shares=True)
    assert by_company(table, "avg_monthly_payments", "schedule_share_recurring", "share_rent") == {
        1: (13.0, 0.5, 1.0)
    }
