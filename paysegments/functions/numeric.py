"""Numeric column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """Double division; a zero denominator gives NULL instead of an error."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def log_positive(value: Column) -> Column:
    """Natural log, NULL where the argument is not positive."""
    return F.when(value > 0, F.log(value))


def distance(cols: Sequence[str], point: Sequence[float]) -> Column:
    """Euclidean distance from the row's ``cols`` to a constant point."""
    squares = [(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(cols, point)]
    return F.sqrt(sum(squares[1:], squares[0]))
