"""Words as the operators of this subpackage count them, and rows on their way through a task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysegments.functions.shipping import ship_by_value

ship_by_value(__name__)

# A word is a run of characters other than the six ASCII white-space characters. Python's
# bytes.split() has exactly these six, so tasks split UTF-8 bytes and never Python strings.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def as_row(docs: DataFrame) -> Column:
    """All columns as one, ``row``, so that no name can clash with a task's own columns."""
    return F.struct(*docs.columns).alias("row")


def row_type(docs: DataFrame, carry: Sequence[str]) -> str:
    """The type of ``row`` with the columns ``carry`` only, as part of a schema string."""
    fields = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in carry)
    return f"row struct<{fields}>"


def with_columns(rows: pa.StructArray, carry: Sequence[str], **columns: pa.Array) -> pa.RecordBatch:
    """The output of a task: ``row`` with the columns ``carry``, and new columns beside it."""
    kept = pa.StructArray.from_arrays([rows.field(c) for c in carry], list(carry))
    return pa.RecordBatch.from_arrays([kept, *columns.values()], ["row", *columns])


def as_bytes(text: pa.StringScalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def send(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast an object together with its class; tasks call the result to get a copy.

    A plain broadcast names the class, and executors may lack the module that holds it.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


# Rows of an Arrow batch. Texts can be long, and tasks and executors hold a batch or two.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Make the session send at most BATCH_ROWS rows to a task at a time."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))
