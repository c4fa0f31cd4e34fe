"""Positions of rows in an order, inside groups of any size.

Rows are sorted by ranges of (group, order), so a group that is larger than a partition
spans several, and each row gets its position in its partition. Only one count per
partition and group is added up, so no task sees more than a partition of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysegments.functions.lineage import Scratch

# monotonically_increasing_id() has the partition above these bits, and the row in it below.
ROW_BITS = 33


def group_key(value: Column) -> Column:
    """A value as text that is never null: null comes first, others keep their bytewise order."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def ranked(rows: DataFrame, group: str, order: Sequence[Column], scratch: Scratch) -> DataFrame:
    """``rows`` with ``rank`` (from 0, inside the group) and ``n`` (rows of the group).

    ``group`` is a column without nulls, and ``rows`` has no column named part, at, place,
    first, before, rank or n. Nulls come first; rows equal in ``order`` are ranked in any
    order. The rows are written to ``scratch``.
    """
    keys = [F.col(group), *order, F.col("place")]
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    laid = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("place")
    laid = scratch.write(laid.withColumn("at", F.monotonically_increasing_id()))
    laid = laid.withColumn("part", F.shiftright("at", ROW_BITS))
    runs = laid.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = runs.select(
        group,
        "part",
        "first",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"),
        F.sum("rows").over(whole).alias("n"),
    )
    found = laid.join(counted, [group, "part"]).withColumn("rank", F.col("at") - F.col("first") + F.col("before"))
    return found.drop("part", "at", "first", "before")
