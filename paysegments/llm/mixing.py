"""Mixing sources to target weights with hash-threshold histograms.

Every document has a size and a hash of its id. A source's target is its share of all
sizes, at most so many times its own size; what is above goes to the others by weight.
A target of 2.4 times the size takes every document twice, and for the rest those with a
hash below a threshold: sizes are summed by source and hash bucket, the running sum finds
the bucket in which the budget ends, and only that bucket is summed again by the next
bits of the hash. After the last level one cell is left per source, taken if that comes
nearer to the budget. Nothing is sorted by document, budgets that grow take supersets,
and the same documents come out on every run.

The documents are read once into a narrow table (id, source, size, hash). The histograms
have at most 4,096 rows per source and level. The thresholds are joined back by source and a salt
from the hash, so a source with a third of all rows is spread over SALTS keys.

Defined results: a null text has size 0; a null source is a source, ordered last; a source
of size 0 has target 0 and takes nothing; documents with equal ids are taken together; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysegments.functions.lineage import materialise
from paysegments.llm.text import word_count

# Three levels of 4,096 buckets: 36 bits of hash, nine hexadecimal digits.
BUCKET_BITS = 12
LEVELS = 3
SALTS = 256


def _hash(key: Column) -> Column:
    digits = BUCKET_BITS * LEVELS // 4
    return F.conv(F.substring(F.md5(key.cast("string")), 1, digits), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and hash of ``docs``."""
    return docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        _hash(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("hash"),
    )


def targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size).

    In the order of the level at which sources reach their limit, a source is held there
    as long as the limit is no more than its share of what those before it have left. The
    first that is not held sets the level for itself and all after it.
    """
    # one row per source: the few rows of this table may meet in one task
    null_last = [F.col("source").isNull(), F.col("source")]
    listed = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    turn = (F.row_number().over(Window.orderBy(*null_last)) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(listed, (turn + 1).cast("int")))
    weighed = weighed.withColumn("most", F.col("source_size") * most)
    order = Window.orderBy(F.col("most") / F.col("weight"), *null_last)
    everything = Window.partitionBy(F.lit(0))
    before = F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranked = weighed.select(
        "*",
        F.row_number().over(order).alias("n"),
        (F.sum("source_size").over(everything) - F.coalesce(before, F.lit(0))).alias("left"),
        F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("shares"),
    )
    free = F.col("most") * F.col("shares") > F.col("weight") * F.col("left")
    level = ranked.withColumn("first", F.min(F.when(free, F.struct("n", "left", "shares"))).over(everything))
    held = F.col("first").isNull() | (F.col("n") < F.col("first.n"))
    share = F.col("weight") * F.col("first.left") / F.col("first.shares")
    return level.select(
        "source", "source_size", F.when(held, F.col("most").cast("double")).otherwise(share).alias("target")
    )


def thresholds(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with rounds (whole takes) and threshold: lower hashes are taken once more."""
    size = F.col("source_size")
    rounds = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("rounds", rounds)
    cells = goals.select(
        F.col("source").alias("s"),
        (F.col("target") - F.col("rounds") * size).alias("budget"),
        F.lit(0).cast("long").alias("prefix"),
    )
    for level in range(LEVELS):
        shift = BUCKET_BITS * (LEVELS - 1 - level)
        same = docs["source"].eqNullSafe(F.col("s"))
        edge = same & (F.shiftright(docs["hash"], shift + BUCKET_BITS) == F.col("prefix"))
        inside = docs.join(cells, edge, "left_semi") if level else docs
        summed = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        running = summed.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")))
        ends = F.min(F.struct("bucket", "size", "upto"))
        cells = (
            cells.join(running, F.col("source").eqNullSafe(F.col("s")) & (F.col("upto") > F.col("budget")))
            .groupBy("s", "budget")
            .agg(ends.alias("end"))
            .select(
                "s",
                (F.col("budget") - (F.col("end.upto") - F.col("end.size"))).alias("budget"),
                F.col("end.bucket").alias("prefix"),
                F.col("end.size").alias("cell"),
            )
        )
    nearer = F.when(F.col("cell") - F.col("budget") < F.col("budget"), 1).otherwise(0)
    ends = cells.select("s", (F.col("prefix") + nearer).alias("threshold"))
    # a source that has reached its limit in whole rounds takes nothing once more, not even empty documents
    left = F.col("target") > F.col("rounds") * size
    return goals.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(
        *goals.columns, F.when(left, F.coalesce("threshold", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("threshold")
    )


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (how often the mix takes it)."""
    narrow = materialise(sized(docs))
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    ends = thresholds(narrow, materialise(targets(sizes, weights, most)))
    salted = ends.select(
        F.col("source").alias("s"),
        *[c for c in ends.columns if c != "source"],
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    of_source = narrow["source"].eqNullSafe(F.col("s")) & (narrow["hash"] % SALTS == F.col("salt"))
    once_more = F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return narrow.join(salted, of_source).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("rounds") + once_more).alias("copies")
    )
