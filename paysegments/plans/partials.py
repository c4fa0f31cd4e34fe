"""Activity by company and month, stored by month, so that a new month is read alone.

Amounts, distinct payments and first and last dates of a month do not depend on other
months, as distinct payments of two months are added up. So the months are stored once, in
a table partitioned by month, and merged on demand; what a window holds beside whole stored
months is read from the payments.

Stored rows cover all companies that have eligible payments: the segment and the window are
applied when months are merged, so one table serves every segment and window. Tables of
other rules of eligibility lie in other folders.

Defined results: payments without a date are in no month; payments without a type are a type
of their own; a month without payments is stored as such and is not read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysegments.config import SegmentConfig
from paysegments.functions.dates import month_start, paid_date
from paysegments.functions.lineage import exists
from paysegments.operators.activity import with_days_since
from paysegments.operators.filters import eligible, in_window, of_segment

SCHEMA = (
    "company_id bigint, payment_type string, grain string, sum_monthly_payments decimal(28,2), "
    "count_monthly_payments bigint, first_date date, last_date date, month date"
)
# What a row stands for: a company's month, one type of it, or only that the month is stored.
COMPANY, TYPE, STORED = "company", "type", "stored"

Months = tuple[date, date]  # first days of the first and of the last month


def next_month(day: date) -> date:
    return date(day.year + day.month // 12, day.month % 12 + 1, 1)


def partials(payments: DataFrame, grains: Sequence[str] = (COMPANY, TYPE)) -> DataFrame:
    """The rows to store. Both grains come from one read: distinct payments by type do not add up."""
    keys = {COMPANY: ["company_id", "month"], TYPE: ["company_id", "month", "payment_type"]}
    rows = payments.select("company_id", "payment_type", "payment_id", "amount", paid_date().alias("paid_date"))
    grain = F.when(F.grouping("payment_type") == 0, TYPE).otherwise(COMPANY)
    return (
        rows.where("paid_date IS NOT NULL")
        .withColumn("month", month_start(F.col("paid_date")))
        .groupingSets([[F.col(c) for c in keys[g]] for g in grains], *map(F.col, keys[TYPE]))
        .agg(
            grain.alias("grain"),
            F.sum("amount").cast("decimal(28,2)").alias("sum_monthly_payments"),
            F.count_distinct("payment_id").alias("count_monthly_payments"),
            F.min("paid_date").alias("first_date"),
            F.max("paid_date").alias("last_date"),
        )
    )


class MonthlyPartials:
    """The stored months below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, cfg: SegmentConfig):
        rule = repr((sorted(cfg.excluded_statuses), sorted(cfg.user_types), cfg.locale))
        self.spark, self.cfg = spark, cfg
        self.path = f"{root.rstrip('/')}/{hashlib.sha256(rule.encode()).hexdigest()[:16]}"

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def stored(self) -> Months | None:
        """The first and last stored month; there are no gaps between them."""
        if not exists(self.spark, self.path):
            return None
        found = self.read().where(F.col("grain") == STORED).agg(F.min("month"), F.max("month")).first()
        return None if found[0] is None else (found[0], found[1])

    def refresh(self, payments: DataFrame, first: date, last: date) -> None:
        """Read the months of ``first`` to ``last`` again and replace what is stored of them.

        Other months are neither read nor written. Run it again if it fails: a month is
        replaced as a whole, and what was not replaced is as it was.
        """
        first, last = first.replace(day=1), last.replace(day=1)
        have = self.stored()
        if last < first:
            raise ValueError(f"months end in {last} before they start in {first}")
        if have and (first > next_month(have[1]) or next_month(last) < have[0]):
            raise ValueError(f"{first} to {last} would leave a gap beside {have[0]} to {have[1]}")
        rows = eligible(payments, self.cfg).where(
            (paid_date() >= F.lit(first)) & (paid_date() < F.lit(next_month(last)))
        )
        every = F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 MONTH"))).alias("month")
        marks = self.spark.range(1).select(F.lit(STORED).alias("grain"), every)
        table = partials(rows).unionByName(marks, allowMissingColumns=True)
        # few files by month, and none that grows with the month
        (
            table.hint("rebalance", "month")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("month")
            .parquet(self.path)
        )

    def _whole(self) -> Months | None:
        """Stored months that lie in the window with all their days."""
        have, cfg = self.stored(), self.cfg
        if have is None:
            return None
        first, last = have
        if cfg.window_start is not None:
            begun = cfg.window_start.replace(day=1)
            first = max(first, begun if begun == cfg.window_start else next_month(begun))
        # the month before that of the day after the window
        last = min(last, ((cfg.window_end + timedelta(1)).replace(day=1) - timedelta(1)).replace(day=1))
        return (first, last) if first <= last else None

    def monthly(self, payments: DataFrame, segments: DataFrame, by_type: bool = False) -> DataFrame:
        """``monthly_activity`` of the window with first and last dates, from the stored months where possible."""
        cfg, whole, grain = self.cfg, self._whole(), TYPE if by_type else COMPANY
        rest = in_window(eligible(payments, cfg), cfg)
        if whole is None:
            found = partials(rest, [grain])
        else:
            first, end = whole[0], next_month(whole[1])
            found = self.read().where((F.col("grain") == grain) & F.col("month").between(*whole))
            beside = []
            if cfg.window_start is None or cfg.window_start < first:
                beside.append(paid_date() < F.lit(first))
            if cfg.window_end >= end:
                beside.append(paid_date() >= F.lit(end))
            for days in beside:
                found = found.unionByName(partials(rest.where(days), [grain]))
        keys = ["company_id", "month"] + (["payment_type"] if by_type else [])
        values = ["sum_monthly_payments", "count_monthly_payments", "first_date", "last_date"]
        return of_segment(found, segments, cfg).select(*keys, F.lit(cfg.segment).alias("segment"), *values)

    def recency(self, monthly: DataFrame) -> DataFrame:
        """Days from the first and last payment to the anchor date, from rows of ``monthly``."""
        dates = monthly.groupBy("company_id").agg(
            F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")
        )
        return with_days_since(dates, self.cfg).drop("first_date", "last_date")
