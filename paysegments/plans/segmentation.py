"""From features to segmented companies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysegments.config import SegmentConfig
from paysegments.functions.lineage import store
from paysegments.operators import medoids, stats
from paysegments.plans.features import FEATURES, payer_features


def feature_table(payments: DataFrame, segments: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """The clustering features as doubles, computed once and kept for the application.

    Everything after this reads one row per company, never the payments.
    """

    def features() -> DataFrame:
        table = payer_features(payments, segments, cfg)
        return table.select("company_id", *[F.col(c).cast("double").alias(c) for c in FEATURES])

    return store(payments.sparkSession).get((payments, segments), f"features {cfg}", features)


def scaled_features(payments: DataFrame, segments: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """The features logged and scaled, kept in the same way."""

    def scaled() -> DataFrame:
        logged = stats.transform(feature_table(payments, segments, cfg), cfg)
        return stats.robust_scale(logged, FEATURES)

    return store(payments.sparkSession).get((payments, segments), f"scaled {cfg}", scaled)


def company_clusters(
    payments: DataFrame, segments: DataFrame, cfg: SegmentConfig, k: int = 4
) -> DataFrame:
    """The scaled features with each company's PAM cluster."""
    scaled = scaled_features(payments, segments, cfg)
    chosen = medoids.kmedoids(scaled, FEATURES, k, method="pam")
    return medoids.assign(scaled, FEATURES, chosen).drop("distance")


def elbow_table(
    payments: DataFrame, segments: DataFrame, cfg: SegmentConfig, ks: Sequence[int] = range(1, 11)
) -> DataFrame:
    return medoids.elbow(scaled_features(payments, segments, cfg), FEATURES, list(ks))
