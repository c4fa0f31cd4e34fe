"""Registered queries: name -> callable(spark, sf_dir), on the star-schema inputs.

Dates leave as text and amounts as doubles, doubles rounded to 6 places, so that
two engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysegments.functions.dates import days_until, month_start, months_between_starts, paid_date
from paysegments.functions.lineage import new_folder
from paysegments.operators import activity, filters, medoids, shares, stats
from paysegments.plans import features, segmentation
from paysegments.plans.features import FEATURES
from paysegments.plans.partials import MonthlyPartials
from paysegments.sources.star import STAR, payments, segments

Query = Callable[[SparkSession, str], DataFrame]

ALL = STAR.all_history()
K = 4


def comparable(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.IntegerType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def _on_inputs(build: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """A query of (payments, segments)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(build(payments(spark, sf_dir), segments(spark, sf_dir)))

    return run


def scalar_dates(p: DataFrame) -> DataFrame:
    """The date functions side by side, on every payment."""
    anchor = F.lit(STAR.anchor)
    return p.select(
        "payment_id",
        paid_date().alias("paid_date"),
        month_start(paid_date()).alias("paid_month"),
        anchor.alias("anchor_date"),
        days_until(STAR.anchor, paid_date()).alias("days_to_anchor"),
        months_between_starts(month_start(paid_date()), month_start(anchor)).alias("months_to_anchor"),
    )


def _monthly(p: DataFrame, s: DataFrame, cfg=STAR, by_type: bool = False) -> DataFrame:
    return activity.monthly_activity(p, s, cfg, by_type)


def _rollup(p: DataFrame, s: DataFrame, cfg=STAR) -> DataFrame:
    return activity.activity_rollup(_monthly(p, s, cfg))


def _from_months(build: Callable[[MonthlyPartials, DataFrame, DataFrame], DataFrame]):
    """A query of (stored months, payments, segments), the last month of the window not stored yet."""

    def run(p: DataFrame, s: DataFrame) -> DataFrame:
        months = MonthlyPartials(p.sparkSession, new_folder(p.sparkSession), STAR)
        months.refresh(p, STAR.window_start, date(2001, 5, 31))
        months.refresh(p, date(2001, 6, 1), date(2001, 7, 31))
        return build(months, p, s)

    return run


def _logged(p: DataFrame, s: DataFrame, log_first: bool = True) -> DataFrame:
    return stats.transform(segmentation.feature_table(p, s, STAR), STAR, log_first)


def _scaled(p: DataFrame, s: DataFrame) -> DataFrame:
    return segmentation.scaled_features(p, s, STAR)


def _medoid_init(p: DataFrame, s: DataFrame) -> DataFrame:
    with medoids.PointSpace(_scaled(p, s), FEATURES) as space:
        ranked = medoids.ranked_by_total(space, K)
    rows = [(i, m.id, total) for i, (total, m) in enumerate(ranked, 1)]
    return p.sparkSession.createDataFrame(
        rows, "position bigint, company_id bigint, total_distance double"
    )


def _at_start(build: Callable[[DataFrame, medoids.Medoids], DataFrame]):
    """A query of (scaled points, starting medoids)."""

    def run(p: DataFrame, s: DataFrame) -> DataFrame:
        scaled = _scaled(p, s)
        return build(scaled, medoids.init_medoids(scaled, FEATURES, K))

    return run


def _assigned(scaled: DataFrame, chosen: medoids.Medoids) -> DataFrame:
    return medoids.assign(scaled, FEATURES, chosen).select("company_id", "cluster", "distance")


def _pam_summary(p: DataFrame, s: DataFrame) -> DataFrame:
    """The fitted medoids with the size and the loss of their clusters."""
    scaled = _scaled(p, s)
    chosen = medoids.kmedoids(scaled, FEATURES, K, method="pam")
    ids = F.array(*[F.lit(m.id).cast("bigint") for m in chosen])
    return (
        _assigned(scaled, chosen)
        .groupBy("cluster")
        .agg(F.count("company_id").alias("n_companies"), F.sum("distance").alias("loss"))
        .withColumn("medoid_id", F.get(ids, F.col("cluster")))
    )


def queries() -> dict[str, Query]:
    return {
        # sources and row filters
        "payments_scan": _on_inputs(lambda p, s: p),
        "segments_scan": _on_inputs(lambda p, s: s),
        "eligible_payments": _on_inputs(lambda p, s: filters.eligible(p, STAR)),
        "segment_members": _on_inputs(lambda p, s: filters.segment_members(s, STAR)),
        "window_payments": _on_inputs(lambda p, s: filters.in_window(p, STAR)),
        "history_payments": _on_inputs(lambda p, s: filters.in_window(p, ALL)),
        "recent_companies": _on_inputs(lambda p, s: filters.recent_companies(p, STAR)),
        "scalar_dates": _on_inputs(lambda p, s: scalar_dates(p)),
        "segment_distinct": _on_inputs(lambda p, s: s.distinct()),
        # joins
        "join_raw_segment": _on_inputs(
            lambda p, s: filters.with_raw_segment(
                filters.in_window(filters.eligible(p, STAR), STAR), s, STAR
            )
        ),
        "join_segment": _on_inputs(lambda p, s: filters.with_segment(filters.eligible(p, STAR), s)),
        "join_segment_driven": _on_inputs(
            lambda p, s: filters.segment_payments(s, filters.eligible(p, STAR), STAR)
        ),
        "join_recent_semi": _on_inputs(lambda p, s: filters.keep_recent(_rollup(p, s), p, STAR)),
        # activity
        "recency": _on_inputs(lambda p, s: activity.recency(p, s, STAR)),
        "recency_all": _on_inputs(lambda p, s: activity.recency(p, s, ALL)),
        "monthly_activity": _on_inputs(_monthly),
        "monthly_activity_all": _on_inputs(lambda p, s: _monthly(p, s, ALL)),
        "monthly_activity_by_type": _on_inputs(
            lambda p, s: _monthly(p, s, by_type=True)
        ),
        "activity_rollup": _on_inputs(_rollup),
        "activity_rollup_all": _on_inputs(lambda p, s: _rollup(p, s, ALL)),
        "frequency": _on_inputs(lambda p, s: activity.frequency(_rollup(p, s))),
        "frequency_all": _on_inputs(lambda p, s: activity.frequency(_rollup(p, s, ALL))),
        "type_totals": _on_inputs(
            lambda p, s: activity.type_totals(_monthly(p, s, by_type=True))
        ),
        "recency_from_months": _on_inputs(_from_months(lambda m, p, s: m.recency(m.monthly(p, s)))),
        "frequency_from_months": _on_inputs(
            _from_months(lambda m, p, s: activity.frequency(activity.activity_rollup(m.monthly(p, s))))
        ),
        "type_totals_from_months": _on_inputs(
            _from_months(lambda m, p, s: activity.type_totals(m.monthly(p, s, by_type=True)))
        ),
        # distinct counts, shares and pivots
        "schedule_distincts": _on_inputs(lambda p, s: shares.schedule_distincts(p, s, STAR)),
        "schedule_shares": _on_inputs(
            lambda p, s: shares.schedule_shares(shares.schedule_distincts(p, s, STAR))
        ),
        "schedule_pivot": _on_inputs(lambda p, s: shares.schedule_pivot(p, s, STAR)),
        "type_shares": _on_inputs(lambda p, s: shares.type_shares(s, p, STAR)),
        "type_share_pivot": _on_inputs(lambda p, s: shares.type_share_pivot(s, p, STAR)),
        "type_amount_pivot": _on_inputs(lambda p, s: features.amount_mix(p, s, STAR)),
        # feature tables
        "rfm_features_12m": _on_inputs(lambda p, s: features.payer_features(p, s, STAR)),
        "rfm_features_all": _on_inputs(lambda p, s: features.payer_features_all(p, s, STAR)),
        "rfm_features_all_totals": _on_inputs(
            lambda p, s: features.payer_features_all(p, s, STAR, include_totals=True)
        ),
        "rfm_with_type_shares": _on_inputs(
            lambda p, s: features.payer_features_all(p, s, STAR, include_type_shares=True)
        ),
        # table statistics
        "feature_head": _on_inputs(lambda p, s: stats.head(features.payer_features(p, s, STAR))),
        "feature_shape": _on_inputs(lambda p, s: stats.shape(features.payer_features(p, s, STAR))),
        "profile_raw": _on_inputs(
            lambda p, s: stats.profile(segmentation.feature_table(p, s, STAR), FEATURES)
        ),
        "transformed": _on_inputs(_logged),
        "transformed_linear": _on_inputs(lambda p, s: _logged(p, s, log_first=False)),
        "profile_transformed": _on_inputs(lambda p, s: stats.profile(_logged(p, s), FEATURES)),
        "scaled": _on_inputs(_scaled),
        "profile_scaled": _on_inputs(lambda p, s: stats.profile(_scaled(p, s), FEATURES)),
        # clustering
        "medoid_init": _on_inputs(_medoid_init),
        "distance_pairs": _on_inputs(
            _at_start(lambda x, m: medoids.distance_pairs(x, FEATURES, m))
        ),
        "medoid_assign": _on_inputs(_at_start(_assigned)),
        "medoid_inertia": _on_inputs(_at_start(lambda x, m: medoids.inertia(_assigned(x, m)))),
        "elbow": _on_inputs(lambda p, s: segmentation.elbow_table(p, s, STAR)),
        "pam4": _on_inputs(_pam_summary),
        "company_clusters": _on_inputs(lambda p, s: segmentation.company_clusters(p, s, STAR, K)),
    }
