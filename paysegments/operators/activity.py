"""Recency, monthly activity and frequency per company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysegments.config import SegmentConfig, slug
from paysegments.functions.dates import days_until, month_start, months_between_starts, paid_date
from paysegments.functions.numeric import ratio
from paysegments.operators.filters import eligible, in_window, of_segment


def recency(
    payments: DataFrame, segments: DataFrame, cfg: SegmentConfig
) -> DataFrame:
    """Days from the first and last payment in the window to the anchor date."""
    rows = of_segment(in_window(eligible(payments, cfg), cfg), segments, cfg)
    dates = rows.groupBy("company_id").agg(
        F.min(paid_date()).alias("first_date"), F.max(paid_date()).alias("last_date")
    )
    return with_days_since(dates, cfg).drop("first_date", "last_date")


def with_days_since(dates: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """Days from ``first_date`` and ``last_date`` to the anchor date."""
    return dates.withColumns(
        {
            "days_since_first_tx": days_until(cfg.anchor, F.col("first_date")),
            "days_since_last_tx": days_until(cfg.anchor, F.col("last_date")),
        }
    )


def monthly_activity(
    payments: DataFrame,
    segments: DataFrame,
    cfg: SegmentConfig,
    by_type: bool = False,
) -> DataFrame:
    """Amount and distinct payments per company and month (and payment type)."""
    keys = ["company_id", "month"] + (["payment_type"] if by_type else [])
    rows = of_segment(in_window(eligible(payments, cfg), cfg), segments, cfg)
    monthly = (
        rows.withColumn("month", month_start(paid_date()))
        .groupBy(*keys)
        .agg(
            F.sum("amount").alias("sum_monthly_payments"),
            F.count_distinct("payment_id").alias("count_monthly_payments"),
        )
    )
    return monthly.select(
        *keys,
        F.lit(cfg.segment).alias("segment"),
        "sum_monthly_payments",
        "count_monthly_payments",
    )


def activity_rollup(monthly: DataFrame) -> DataFrame:
    """Months to company. A payment seen in two months counts in both."""
    return monthly.groupBy("company_id").agg(
        F.min("month").alias("first_active_month"),
        F.max("month").alias("last_active_month"),
        F.sum("sum_monthly_payments").alias("total_payments"),
        F.sum("count_monthly_payments").alias("total_payment_count"),
    )


def frequency(rollup: DataFrame) -> DataFrame:
    """Totals per month between the first and last active month, at least one."""
    months = F.greatest(
        F.lit(1).cast("bigint"),
        months_between_starts(F.col("first_active_month"), F.col("last_active_month")),
    )
    return rollup.withColumns(
        {
            "avg_monthly_payments": ratio(F.col("total_payments"), months),
            "avg_monthly_payment_count": ratio(F.col("total_payment_count"), months),
        }
    )


def type_totals(monthly_by_type: DataFrame) -> DataFrame:
    """Months to company and payment type."""
    return monthly_by_type.groupBy("company_id", "payment_type").agg(
        F.sum("sum_monthly_payments").alias("total_payments"),
        F.sum("count_monthly_payments").alias("total_payment_count"),
    )


def type_amount_pivot(totals: DataFrame, cfg: SegmentConfig, counted: Column | None = None, *more: Column) -> DataFrame:
    """One amount column per listed type, 0 where absent; totals cover all types.

    The cell is a maximum, not a sum: a negative amount shows as 0 beside any
    other type of the company and as itself where it is the only row. Rows that are not
    ``counted`` take no part, except in ``more``, further aggregates by company.
    """
    counted = F.lit(True) if counted is None else counted
    zero = F.lit(0).cast(totals.schema["total_payments"].dataType)

    def cell(name: str) -> Column:
        listed = F.when(F.col("payment_type") == name, F.col("total_payments")).otherwise(zero)
        return F.max(F.when(counted, listed)).alias(f"amount_{slug(name)}")

    return totals.groupBy("company_id").agg(
        *[cell(t) for t in cfg.payment_types],
        F.sum(F.when(counted, F.col("total_payments"))).alias("sum_total_payments"),
        F.sum(F.when(counted, F.col("total_payment_count"))).alias("sum_total_payment_count"),
        *more,
    )
