"""Row filters on payments, and how payments meet the segment lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysegments.config import SegmentConfig
from paysegments.functions.dates import paid_date


def is_eligible(cfg: SegmentConfig) -> Column:
    return (
        ~F.col("status").isin(*cfg.excluded_statuses)
        & F.col("user_type").isin(*cfg.user_types)
        & (F.col("locale_id") == F.lit(cfg.locale))
    )


def is_in_window(cfg: SegmentConfig) -> Column:
    """Both ends inclusive; open at the start when the window covers all history."""
    if cfg.window_start is None:
        return paid_date() <= F.lit(cfg.window_end)
    return paid_date().between(F.lit(cfg.window_start), F.lit(cfg.window_end))


def is_recent(cfg: SegmentConfig) -> Column:
    return paid_date() >= F.lit(cfg.recent_since)


def eligible(payments: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """Status, user type and locale; a NULL in any of them drops the row."""
    return payments.where(is_eligible(cfg))


def in_window(payments: DataFrame, cfg: SegmentConfig) -> DataFrame:
    return payments.where(is_in_window(cfg))


def in_segment(rows: DataFrame, cfg: SegmentConfig) -> DataFrame:
    return rows.where(F.col("segment") == cfg.segment)


def segment_members(segments: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """Companies listed at least once under the segment, one row each."""
    return in_segment(segments, cfg).select("company_id").distinct()


def recent_companies(payments: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """Companies with any payment since the date, whatever its status or owner."""
    return payments.where(is_recent(cfg)).select("company_id").distinct()


def keep_recent(rows: DataFrame, payments: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """Semi join; ``rows`` should already be aggregated to few rows per company."""
    return rows.join(recent_companies(payments, cfg), "company_id", "left_semi")


def with_raw_segment(payments: DataFrame, segments: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """Payments of the segment, repeated for every repeated lookup row.

    The joins of raw payments carry no hint: Spark broadcasts the lookup when
    its size allows, else sort-merges, where AQE splits a company's hot partition.
    """
    return payments.join(in_segment(segments, cfg).select("company_id"), "company_id")


def with_segment(payments: DataFrame, segments: DataFrame) -> DataFrame:
    """Payments with each distinct owner of their company."""
    return payments.join(segments.distinct(), "company_id")


def segment_payments(segments: DataFrame, payments: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """Lookup rows of the segment with their payments, lookup not deduplicated."""
    return in_segment(segments, cfg).join(payments, "company_id")


def of_segment(payments: DataFrame, segments: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """Payments of the segment's companies, each once.

    One semi join at any size, before everything that shuffles payments. Spark broadcasts
    the companies where their size allows. Beyond that it can filter payments with a
    Bloom filter of the companies before the shuffle, and AQE splits a hot company.
    """
    return payments.join(segment_members(segments, cfg), "company_id", "left_semi")
