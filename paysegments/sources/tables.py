"""Readers for the two inputs, from files or catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PAYMENTS = T.StructType(
    [
        T.StructField("company_id", T.LongType()),
        T.StructField("payment_id", T.LongType()),
        T.StructField("schedule_id", T.LongType()),
        T.StructField("schedule_type", T.StringType()),
        T.StructField("payment_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("user_type", T.StringType()),
        T.StructField("locale_id", T.IntegerType()),
        T.StructField("paid_at", T.TimestampNTZType()),
        T.StructField("amount", T.DecimalType(18, 2)),
    ]
)

SEGMENTS = T.StructType(
    [
        T.StructField("company_id", T.LongType()),
        T.StructField("segment", T.StringType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Check names and types against ``schema`` and put the columns in its order.

    Extra columns are left out, so they are never read from a columnar source.
    """
    found = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: expected {f.dataType.simpleString()}, "
        f"found {found[f.name].simpleString() if f.name in found else 'nothing'}"
        for f in schema.fields
        if found.get(f.name) != f.dataType
    ]
    if wrong:
        raise ValueError("input does not match its schema: " + "; ".join(wrong))
    return df.select(*schema.names)


def _read(spark: SparkSession, source: str, fmt: str) -> DataFrame:
    return spark.table(source) if fmt == "table" else spark.read.format(fmt).load(source)


def read_payments(spark: SparkSession, source: str, fmt: str = "parquet") -> DataFrame:
    return conform(_read(spark, source, fmt), PAYMENTS)


def read_segments(spark: SparkSession, source: str, fmt: str = "parquet") -> DataFrame:
    return conform(_read(spark, source, fmt), SEGMENTS)
