"""Table statistics, the log transform and robust scaling.

Exact quantiles take two jobs whatever the size. The first works out moments and a
mergeable sketch per column, and the sketch brackets every quantile with certainty. The
second counts what lies below each bracket and ranks the values inside. Only the moments,
the ends of the brackets and the values at the wanted ranks reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import ceil, floor
from operator import or_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from paysegments.config import SegmentConfig
from paysegments.functions.numeric import log_positive

# Ranks in a sketch are wrong by at most one part in so many of the values.
ACCURACY = 10_000

QUARTILES = (0.25, 0.5, 0.75)


def head(df: DataFrame, key: str = "company_id", n: int = 5) -> DataFrame:
    """First rows by key; a DataFrame has no order of its own."""
    return df.orderBy(key).limit(n)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_cols")
    )


def is_finite(value: Column) -> Column:
    """False for NULL, NaN and the infinities."""
    number = value.cast("double")
    return F.coalesce(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), F.lit(False))


def margins(accuracy: int) -> list[float]:
    """How far to both sides of a quantile a bracket may be asked for, as parts of the values."""
    return [2 / accuracy, min(500 / accuracy, 1.0)]


def sketch_points(probs: Sequence[float], accuracy: int) -> list[float]:
    """The quantiles that a sketch is asked for: both ends of all brackets."""
    return [min(max(p + side * m, 0.0), 1.0) for p in probs for m in margins(accuracy) for side in (-1, 1)]


def moments(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUARTILES, accuracy: int = ACCURACY) -> dict[str, Row]:
    """Count, mean, sample deviation, minimum, maximum and sketched quantiles per column, in one pass."""
    points = sketch_points(probs, accuracy)
    found = df.agg(
        F.struct(F.count(F.lit(1)).alias("n")).alias("__rows"),
        *[
            F.struct(
                F.count(c).alias("count"),
                F.avg(c).cast("double").alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
                F.count_if(F.col(c).isNotNull() & ~is_finite(F.col(c))).alias("odd"),
                F.percentile_approx(F.col(c).cast("double"), points, accuracy).alias("sketch"),
            ).alias(c)
            for c in cols
        ],
    ).first()
    return found.asDict()


Bracket = tuple[str, float, float]  # column and the values at both ends


def bracket(col: str, known: Row, which: int, accuracy: int) -> Bracket:
    """The narrowest bracket that surely holds the values around the ``which``-th quantile.

    A margin holds if it exceeds the sketch's error by two values at least; all values do.
    """
    for i, margin in enumerate(margins(accuracy)):
        if margin < 1 and (margin - 1 / accuracy) * known["count"] >= 2:
            at = 2 * (which * len(margins(accuracy)) + i)
            return col, known["sketch"][at], known["sketch"][at + 1]
    return col, known["min"], known["max"]


def order_statistics(df: DataFrame, ranks: Mapping[Bracket, set[int]]) -> dict[tuple[str, int], float]:
    """Exact values at 0-based ranks, each looked for in its bracket, in one job.

    Values inside are counted before they move, so equal ones are one row. What is below
    is a row of its own in front, so the running count is the rank.
    """
    brackets = list(ranks)

    def value(b: Bracket) -> Column:
        return F.col(b[0]).cast("double")

    entries = [
        F.when(value(b).between(F.lit(b[1]), F.lit(b[2])), F.struct(F.lit(i).alias("bracket"), value(b).alias("x")))
        for i, b in enumerate(brackets)
    ]
    inside = (
        df.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy("e.bracket", "e.x")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    below = df.agg(F.array(*[F.count_if(value(b) < F.lit(b[1])) for b in brackets]).alias("n"))
    below = below.select(F.posexplode("n").alias("bracket", "n")).select("bracket", F.lit(None).cast("double").alias("x"), "n")
    running = Window.partitionBy("bracket").orderBy("x")
    counted = inside.unionByName(below).withColumn("upto", F.sum("n").over(running))
    wanted = [(i, rank) for i, b in enumerate(brackets) for rank in sorted(ranks[b])]
    hits = [(F.col("bracket") == i) & (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank) for i, rank in wanted]
    rows = counted.where(F.col("x").isNotNull() & reduce(or_, hits)).collect()  # one row per wanted rank at most
    found = {}
    for i, rank in wanted:
        # fails if a sketch broke its promise
        found[brackets[i][0], rank] = next(
            r["x"] for r in rows if r["bracket"] == i and r["upto"] - r["n"] <= rank < r["upto"]
        )
    return found


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float] = QUARTILES,
    known: Mapping[str, Row] | None = None,
    accuracy: int = ACCURACY,
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, of the values that are not NULL.

    ``df`` is read twice more where ``known`` (of the same ``probs`` and ``accuracy``) is
    given, and three times else. NaN and infinite values are refused.
    """
    known = known or moments(df, cols, probs, accuracy)
    require_finite({c: known[c]["odd"] for c in cols})
    filled = [c for c in cols if known[c]["count"]]
    places = {c: [(known[c]["count"] - 1) * p for p in probs] for c in filled}
    ranks: dict[Bracket, set[int]] = {}
    for c in filled:
        for which, x in enumerate(places[c]):
            ranks.setdefault(bracket(c, known[c], which, accuracy), set()).update((floor(x), ceil(x)))
    at = order_statistics(df, ranks) if ranks else {}
    result: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    for c in filled:
        result[c] = [
            at[c, floor(x)] + (at[c, ceil(x)] - at[c, floor(x)]) * (x - floor(x)) for x in places[c]
        ]
    return result


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Summary statistics, one row per column of ``cols``."""
    known = moments(df, cols)
    quarters = quantiles(df, cols, QUARTILES, known)
    rows = [
        (c, m["count"], m["mean"], m["std"], m["min"], *quarters[c], m["max"])
        for c, m in ((c, known[c]) for c in cols)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "feature string, count bigint, mean double, std double, min double, "
        "p25 double, p50 double, p75 double, max double",
    )


def transform(df: DataFrame, cfg: SegmentConfig, log_first: bool = True) -> DataFrame:
    """Logs of four of the five features; the recurring share stays as it is.

    Days since the first payment are turned round first. ``390 - days`` at or
    below zero has no log and gives NULL.
    """
    left = F.lit(cfg.recency_ceiling) - F.col("days_since_first_tx")
    logs = {
        c: F.log1p(c)
        for c in ("days_since_last_tx", "avg_monthly_payment_count", "avg_monthly_payments")
    }
    first = log_positive(left) if log_first else left
    return df.withColumns({"days_since_first_tx": first.cast("double"), **logs})


def require_complete(n: int, missing: Mapping[str, int]) -> None:
    """Refuse columns that lack a finite value in some rows."""
    gaps = [f"{c} is missing or not finite in {m}" for c, m in missing.items() if m]
    if gaps:
        raise ValueError(f"of {n} rows, " + ", ".join(gaps))


def require_finite(odd: Mapping[str, int]) -> None:
    found = [f"{c} has {n} values that are NaN or infinite" for c, n in odd.items() if n]
    if found:
        raise ValueError(", ".join(found))


def robust_fit(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Median and interquartile range per column; a range of 0 counts as 1."""
    known = moments(df, cols)
    n = known["__rows"]["n"]
    require_complete(n, {c: n - known[c]["count"] + known[c]["odd"] for c in cols})
    quarters = quantiles(df, cols, QUARTILES, known)
    return {c: (q[1], (q[2] - q[0]) or 1.0) for c, q in quarters.items() if q[1] is not None}


def robust_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - median) / interquartile range; ``df`` should be cheap to read twice."""
    fitted = robust_fit(df, cols)
    return df.withColumns(
        {c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()}
    )
