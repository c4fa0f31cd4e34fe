"""Distinct counts by type, their shares, and pivots of both.

Each distinct count removes duplicates in a shuffle keyed by company *and* id,
after a map-side combine. A company holding most payments is spread over many
tasks, and an id repeated very often shrinks to one row per task first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysegments.config import SegmentConfig, slug
from paysegments.functions.numeric import ratio
from paysegments.operators.filters import eligible, of_segment

# Types marked per bit column; a bigint has 63 usable bits and one is kept back.
_BITS = 62

SCHEDULE_IDS = {"schedule": "schedule_id", "payment": "payment_id"}


def _long_ids(rows: DataFrame, type_col: str, ids: Mapping[str, str]) -> DataFrame:
    """One row per (company, type, kind of id, id) occurrence."""
    each = [F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id")) for kind, c in ids.items()]
    entry = F.explode(F.array(*each)) if len(each) > 1 else each[0]
    return rows.select("company_id", F.col(type_col).alias("type"), entry.alias("entry")).select(
        "company_id", "type", "entry.kind", "entry.id"
    )


def distinct_counts(rows: DataFrame, type_col: str, ids: Mapping[str, str]) -> DataFrame:
    """Distinct ids per (company, type) and per company, one row per (company, type).

    NULL ids are not counted, a NULL type is a type of its own. An id is one shuffled row
    with the few types it has; for the company only its first type counts it.
    """
    company = Window.partitionBy("company_id")
    none = F.when(F.max(F.col("type").isNull()), F.array(F.lit(None).cast("string"))).otherwise(
        F.array().cast("array<string>")
    )
    per_id = (
        _long_ids(rows, type_col, ids)
        .groupBy("company_id", "kind", "id")
        .agg(F.concat(F.sort_array(F.collect_set("type")), none).alias("types"))
    )
    flagged = per_id.select("company_id", "kind", "id", F.posexplode("types").alias("position", "type"))
    leads = F.col("position") == 0
    by_type = flagged.groupBy("company_id", "type").agg(
        *[F.count(F.when(F.col("kind") == k, F.col("id"))).alias(f"n_{k}") for k in ids],
        *[F.count(F.when((F.col("kind") == k) & leads, F.col("id"))).alias(f"led_{k}") for k in ids],
    )
    return by_type.select(
        "company_id",
        F.col("type").alias(type_col),
        *[F.sum(f"led_{k}").over(company).alias(f"count_{k}_all") for k in ids],
        *[F.col(f"n_{k}").alias(f"count_{k}_by_type") for k in ids],
    )


def schedule_distincts(payments: DataFrame, segments: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """Distinct schedules and payments by company and schedule type, over all dates."""
    rows = of_segment(eligible(payments, cfg), segments, cfg)
    return distinct_counts(rows, "schedule_type", SCHEDULE_IDS)


def schedule_shares(distincts: DataFrame) -> DataFrame:
    """Share of the company's schedules and payments under each schedule type."""
    for kind in SCHEDULE_IDS:
        share = ratio(F.col(f"count_{kind}_by_type"), F.col(f"count_{kind}_all"))
        distincts = distincts.withColumn(f"{kind}_share", share)
    return distincts


def type_shares(segments: DataFrame, payments: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """Share of the company's payments under each payment type, over all dates."""
    rows = of_segment(eligible(payments, cfg), segments, cfg)
    counts = distinct_counts(rows, "payment_type", {"payment": "payment_id"})
    return counts.select(
        "company_id",
        "payment_type",
        ratio(F.col("count_payment_by_type"), F.col("count_payment_all")).alias("payment_type_share"),
    )


def _bit(position: int) -> Column:
    return F.lit(1 << position).cast("bigint")


def _marks(column: str, types: Sequence[str]) -> list[Column]:
    """Bit columns telling which listed types a row has; bit 62 of the first: none of them."""
    type_ = F.col(column)
    columns = []
    for start in range(0, max(len(types), 1), _BITS):
        mark = F.when(F.lit(False), _bit(0))
        for i, t in enumerate(types[start : start + _BITS]):
            mark = mark.when(type_ == t, _bit(i))
        other = F.lit(0).cast("bigint")
        if start == 0:
            listed = F.coalesce(type_.isin(*types), F.lit(False)) if types else F.lit(False)
            other = F.when(~listed, _bit(_BITS)).otherwise(other)
        columns.append(F.coalesce(mark, other))
    return columns


@dataclass(frozen=True)
class Kind:
    """Ids to count, and the listed types to count them by."""

    name: str
    id: str
    type: str
    types: tuple[str, ...]


def typed_counts(rows: DataFrame, kinds: Sequence[Kind]) -> DataFrame:
    """Distinct ids per company, in all and under each listed type, in one row.

    One pass for all kinds of ids: an id is one shuffled row however many types it has,
    since its types travel as bits. ``<kind>_has_<i>`` tells whether type i occurs at all,
    ``<kind>_has_other`` whether a type off the list (or NULL) does.
    """
    marks = {k.name: _marks(k.type, k.types) for k in kinds}
    width = max(map(len, marks.values()))
    names = [f"mark_{i}" for i in range(width)]
    entries = [
        F.struct(
            F.lit(k.name).alias("kind"),
            F.col(k.id).alias("id"),
            *[
                (marks[k.name][i] if i < len(marks[k.name]) else F.lit(0).cast("bigint")).alias(n)
                for i, n in enumerate(names)
            ],
        )
        for k in kinds
    ]
    each = F.explode(F.array(*entries)) if len(entries) > 1 else entries[0]
    per_id = (
        rows.select("company_id", each.alias("e"))
        .select("company_id", "e.*")
        .groupBy("company_id", "kind", "id")
        .agg(*[F.bit_or(n).alias(n) for n in names])
    )

    def has(i: int) -> Column:
        return F.col(names[i // _BITS]).bitwiseAND(_bit(i % _BITS)) != 0

    other = F.col(names[0]).bitwiseAND(_bit(_BITS)) != 0
    found = []
    for k in kinds:
        mine = F.col("kind") == k.name
        id_ = F.when(mine, F.col("id"))
        found.append(F.count(id_).alias(f"{k.name}_all"))
        found += [F.count(F.when(has(i), id_)).alias(f"{k.name}_{i}") for i in range(len(k.types))]
        found += [F.max(mine & has(i)).alias(f"{k.name}_has_{i}") for i in range(len(k.types))]
        found.append(F.max(mine & other).alias(f"{k.name}_has_other"))
    return per_id.groupBy("company_id").agg(*found)


def _schedule_columns(kind: str) -> list[Column]:
    """Counts and shares of one-off and recurring ids.

    A missing type gives 0. Where the company has no id at all the share is
    NULL if its rows are all of that one type, else 0, as the maximum over its
    types of "share if the type matches, else 0" would be.
    """
    columns = []
    for i, label in enumerate(("oneoff", "recurring")):
        elsewhere = F.col(f"{kind}_has_other") | F.col(f"{kind}_has_{1 - i}")
        share = ratio(F.col(f"{kind}_{i}"), F.col(f"{kind}_all"))
        columns.append(F.col(f"{kind}_{i}").alias(f"count_{kind}_{label}"))
        columns.append(
            F.coalesce(share, F.when(elsewhere, F.lit(0.0))).alias(f"{kind}_share_{label}")
        )
    return columns


def _type_columns(kind: str, types: Sequence[str]) -> list[Column]:
    """One share column per listed type, NULL where absent."""
    return [
        F.when(F.col(f"{kind}_has_{i}"), ratio(F.col(f"{kind}_{i}"), F.col(f"{kind}_all"))).alias(
            f"share_{slug(t)}"
        )
        for i, t in enumerate(types)
    ]


def _by_schedule_type(cfg: SegmentConfig, ids: Mapping[str, str]) -> list[Kind]:
    return [Kind(name, id_, "schedule_type", (cfg.one_off, cfg.recurring)) for name, id_ in ids.items()]


def _by_payment_type(cfg: SegmentConfig) -> Kind:
    return Kind("payment", "payment_id", "payment_type", cfg.payment_types)


def schedule_pivot(
    payments: DataFrame, segments: DataFrame, cfg: SegmentConfig, ids: Mapping[str, str] = SCHEDULE_IDS
) -> DataFrame:
    """Counts and shares of one-off and recurring schedules and payments per company."""
    rows = of_segment(eligible(payments, cfg), segments, cfg)
    counts = typed_counts(rows, _by_schedule_type(cfg, ids))
    return counts.select("company_id", *[c for kind in ids for c in _schedule_columns(kind)])


def type_share_pivot(segments: DataFrame, payments: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """One share column per listed payment type, NULL where absent.

    A company with off-list types only stays, as a row of NULLs.
    """
    rows = of_segment(eligible(payments, cfg), segments, cfg)
    counts = typed_counts(rows, [_by_payment_type(cfg)])
    return counts.select("company_id", *_type_columns("payment", cfg.payment_types))


def schedule_and_type_shares(payments: DataFrame, segments: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """The schedule shares and the payment-type shares from one read of the payments."""
    rows = of_segment(eligible(payments, cfg), segments, cfg)
    counts = typed_counts(rows, [*_by_schedule_type(cfg, {"schedule": "schedule_id"}), _by_payment_type(cfg)])
    return counts.select(
        "company_id", *_schedule_columns("schedule"), *_type_columns("payment", cfg.payment_types)
    )
