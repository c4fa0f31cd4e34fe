"""Feature tables per company.

The payments are the only large input. Each table reads them as few times as its
date rules allow and carries the result at one row per company from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysegments.config import SegmentConfig
from paysegments.functions.dates import month_start, paid_date
from paysegments.operators.activity import frequency, type_amount_pivot, with_days_since
from paysegments.operators.filters import is_eligible, is_in_window, is_recent, of_segment
from paysegments.operators.shares import schedule_and_type_shares, schedule_pivot

FEATURES = [
    "days_since_first_tx",
    "days_since_last_tx",
    "avg_monthly_payment_count",
    "avg_monthly_payments",
    "schedule_share_recurring",
]
TOTALS = ["first_active_month", "last_active_month", "total_payments", "total_payment_count"]


def _counted_or_recent(payments: DataFrame, segments: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """Payments of the segment that count, or that show recent activity."""
    rows = payments.where((is_eligible(cfg) & is_in_window(cfg)) | is_recent(cfg))
    if cfg.window_start is not None:
        # Implied by the line above; a plain range is what prunes the files.
        rows = rows.where(paid_date() >= F.lit(min(cfg.window_start, cfg.recent_since)))
    return of_segment(rows, segments, cfg)


def company_activity(
    payments: DataFrame,
    segments: DataFrame,
    cfg: SegmentConfig,
    recent_only: bool,
) -> DataFrame:
    """Recency and frequency from one read of the window.

    With ``recent_only`` the same read also finds the recently active companies.
    Any payment makes a company recent, so ineligible ones are read too, without
    amount or id. Distinct payments summed over months are distinct (month,
    payment) pairs.
    """
    counted = is_eligible(cfg) & is_in_window(cfg)
    rows = _counted_or_recent(payments, segments, cfg) if recent_only else of_segment(payments.where(counted), segments, cfg)
    found = (
        rows.select(
            "company_id",
            F.when(counted, paid_date()).alias("paid_date"),
            F.when(counted, F.col("amount")).alias("amount"),
            F.when(counted, F.col("payment_id")).alias("payment_id"),
            is_recent(cfg).alias("recent"),
        )
        .groupBy("company_id")
        .agg(
            F.min("paid_date").alias("first_date"),
            F.max("paid_date").alias("last_date"),
            F.sum("amount").alias("total_payments"),
            F.count_distinct(month_start(F.col("paid_date")), F.col("payment_id")).alias(
                "total_payment_count"
            ),
            F.max("recent").alias("recent"),
        )
    )
    found = found.where(F.col("first_date").isNotNull())
    if recent_only:
        found = found.where("recent")
    months = {
        "first_active_month": month_start(F.col("first_date")),
        "last_active_month": month_start(F.col("last_date")),
    }
    return with_days_since(frequency(found.withColumns(months)), cfg)


def payer_features(
    payments: DataFrame,
    segments: DataFrame,
    cfg: SegmentConfig,
    recent_only: bool = True,
    include_totals: bool = False,
    include_type_shares: bool = False,
) -> DataFrame:
    """The five features per company of the segment, a company missing one left out.

    Recency and frequency follow the window; the shares take all dates.
    """
    active = company_activity(payments, segments, cfg, recent_only)
    columns = ["company_id", *FEATURES]
    if include_totals:
        columns += TOTALS
    if include_type_shares:
        shares = schedule_and_type_shares(payments, segments, cfg)
        columns += [c for c in shares.columns if c.startswith("share_")]
    else:
        shares = schedule_pivot(payments, segments, cfg, {"schedule": "schedule_id"})
    return active.join(shares, "company_id").select(*columns)


def payer_features_all(
    payments: DataFrame,
    segments: DataFrame,
    cfg: SegmentConfig,
    include_totals: bool = False,
    include_type_shares: bool = False,
) -> DataFrame:
    """The same columns over all history, without asking for recent activity."""
    return payer_features(
        payments, segments, cfg.all_history(), False, include_totals, include_type_shares
    )


def amount_mix(payments: DataFrame, segments: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """Amount per payment type of the recently active companies, in the window.

    One read: payments that only show recent activity come along without amount or id.
    """
    counted = is_eligible(cfg) & is_in_window(cfg)
    totals = (
        _counted_or_recent(payments, segments, cfg)
        .groupBy("company_id", "payment_type")
        .agg(
            F.sum(F.when(counted, F.col("amount"))).alias("total_payments"),
            F.count_distinct(
                F.when(counted, month_start(paid_date())), F.when(counted, F.col("payment_id"))
            ).alias("total_payment_count"),
            F.max(counted).alias("counted"),
            F.max(is_recent(cfg)).alias("recent"),
        )
    )
    known = F.coalesce(F.col("counted"), F.lit(False))
    mix = type_amount_pivot(totals, cfg, known, F.max(known).alias("known"), F.max("recent").alias("recent"))
    return mix.where("known AND recent").drop("known", "recent")
