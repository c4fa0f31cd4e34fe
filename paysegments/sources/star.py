"""The two inputs derived from a star schema of orders and line items.

One line item is one payment; its order is the schedule, its customer the
company. ``payment_id`` is deliberately not unique.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysegments.config import SegmentConfig
from paysegments.sources.tables import conform

STAR = SegmentConfig(
    segment="target",
    excluded_statuses=("R",),
    user_types=("BUILDING", "MACHINERY", "HOUSEHOLD", "FURNITURE"),
    locale="O",
    anchor=date(2001, 9, 1),
    window_start=date(2000, 9, 1),
    window_end=date(2001, 8, 31),
    recent_since=date(2001, 6, 1),
    payment_types=("STANDARD", "LARGE", "MEDIUM", "ECONOMY", "SMALL"),
)


# The columns in use.
SCHEMAS = {
    "customer": "c_custkey bigint, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderpriority string",
    "part": "p_partkey bigint, p_type string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_extendedprice double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose own schema has the columns stated, read with these only."""
    return conform(spark.read.parquet(f"{sf_dir}/{name}.parquet"), T.StructType.fromDDL(SCHEMAS[name]))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments in the shape of ``tables.PAYMENTS`` (``locale_id`` is a string here).

    Orders meet their customer first and the line items last, on the order key:
    a customer with very many orders never becomes one task's share of line
    items. An item of an unknown part is a payment without a type.
    """
    orders = _table(spark, sf_dir, "orders")
    customer = _table(spark, sf_dir, "customer")
    part = _table(spark, sf_dir, "part")
    items = _table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    schedules = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")
    return items.join(schedules, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("company_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("payment_id"),
        F.col("l_orderkey").alias("schedule_id"),
        F.when(urgent, STAR.recurring).otherwise(STAR.one_off).alias("schedule_type"),
        F.col("p_type").alias("payment_type"),
        F.col("l_returnflag").alias("status"),
        F.col("c_mktsegment").alias("user_type"),
        F.col("l_linestatus").alias("locale_id"),
        F.col("l_shipdate").alias("paid_at"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("company_id"),
        F.when(F.col("c_acctbal") < 5000, "target").otherwise("other").alias("segment"),
    )
