"""Date arithmetic with integer results."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def paid_date() -> Column:
    """Date part of the payment timestamp; a range on it reaches the scan."""
    return F.to_date("paid_at")


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def days_until(anchor: date, day: Column) -> Column:
    return F.datediff(F.lit(anchor), day).cast("bigint")


def months_between_starts(first: Column, last: Column) -> Column:
    """Whole calendar months from ``first`` to ``last``; adjacent months give 1."""
    years = F.year(last) - F.year(first)
    return (years * 12 + F.month(last) - F.month(first)).cast("bigint")
