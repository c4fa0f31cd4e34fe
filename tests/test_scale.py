"""Plans: what is read, what is pushed down, and where a hot company goes."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from build import CFG, by_company, segments
from paysegments.operators import filters, shares
from paysegments.plans import features
from paysegments.queries import queries
from paysegments.sources import tables

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Payments of 200 companies, one of which has a third of them, as files."""
    path = str(tmp_path_factory.mktemp("skewed") / "payments")
    n = 60_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 200).alias("company_id"),
        F.col("id").alias("payment_id"),
        (F.col("id") / 4).cast("bigint").alias("schedule_id"),
        F.when(F.col("id") % 2 == 0, "recurring").otherwise("one off").alias("schedule_type"),
        F.when(F.col("id") % 5 == 0, "Rent").otherwise("GST").alias("payment_type"),
        F.lit("Success").alias("status"),
        F.lit("business").alias("user_type"),
        F.lit(1).alias("locale_id"),
        F.expr("timestamp_ntz'2023-01-01 12:00:00' + make_dt_interval(int(id % 600))").alias("paid_at"),
        (F.col("id") % 100).cast("decimal(18,2)").alias("amount"),
    )
    rows.repartition(8).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def lookup(spark, tmp_path_factory):
    """The segment's companies as files, of which Spark knows the size."""
    path = str(tmp_path_factory.mktemp("lookup") / "segments")
    segments(spark, *range(200)).write.parquet(path)
    return tables.read_segments(spark, path)


def test_nothing_is_paired_with_everything(spark):
    fits = {"medoid_init", "elbow", "pam4", "medoid_inertia", "company_clusters", "distance_pairs"}
    for name, query in queries().items():
        if name not in fits:
            found = plan(query(spark, SMALL))
            assert "CartesianProduct" not in found and "NestedLoop" not in found, name


def test_features_read_the_payments_twice_and_narrowly(spark, skewed, conf):
    conf(spark__sql__maxMetadataStringLength="10000")
    p = tables.read_payments(spark, skewed)
    text = plan(features.payer_features(p, segments(spark, *range(200)), CFG))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[(.*?)\], ReadSchema", text)
    assert len(scans) == 2
    windowed, shared = sorted(scans, key=lambda s: "paid_at" not in s[0])
    assert "GreaterThanOrEqual(paid_at,2023-09-01T00:00)" in windowed[1]
    assert "payment_type" not in windowed[0] and "schedule_id" not in windowed[0]
    assert "paid_at" not in shared[0] and "amount" not in shared[0]
    assert "Not(In(status" in shared[1] and "EqualTo(locale_id,1)" in shared[1]


@pytest.mark.parametrize(
    "build",
    [
        lambda p, s, cfg: features.payer_features(p, s, cfg),
        lambda p, s, cfg: features.amount_mix(p, s, cfg),
        lambda p, s, cfg: shares.schedule_distincts(p, s, cfg),
        lambda p, s, cfg: shares.type_share_pivot(s, p, cfg),
    ],
)
def test_payments_are_aggregated_before_they_move(spark, skewed, lookup, build):
    """No exchange holds raw payments, and ids are spread by id before they are counted."""
    df = build(tables.read_payments(spark, skewed), lookup, CFG)
    lines = [line.lstrip(" :+-*") for line in plan(df).splitlines()]
    scans = [i for i, line in enumerate(lines) if line.startswith("FileScan") and "status" in line]
    assert scans
    for at in scans:
        first = max(i for i in range(at) if lines[i].startswith("Exchange"))  # not the broadcast
        partial = lines[first + 1]
        assert partial.startswith(("HashAggregate", "ObjectHashAggregate", "SortAggregate"))
        keys = re.search(r"hashpartitioning\((.*?), \d+\)", lines[first]).group(1)
        counts_ids = "payment_id" in lines[at] or "schedule_id" in lines[at]
        assert not counts_ids or len(keys.split(",")) >= 3


def test_hot_company_counts_are_whole(spark, skewed, conf):
    p = tables.read_payments(spark, skewed)
    s = segments(spark, *range(200))
    wide = features.payer_features(p, s, CFG, include_totals=True)
    cols = [*features.FEATURES, *features.TOTALS]
    broadcast = by_company(wide, *cols)
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    )
    assert by_company(features.payer_features(p, s, CFG, include_totals=True), *cols) == broadcast
    hot = p.where("company_id = 0 AND paid_at >= '2023-09-01'").count()
    assert by_company(wide, "total_payment_count")[0] == hot > 10_000


def test_raw_join_splits_a_hot_company(spark, skewed, conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="10KB",
    )
    p = tables.read_payments(spark, skewed)
    joined = filters.with_raw_segment(p, segments(spark, *range(200)), CFG)
    assert len(joined.collect()) == 60_000
    assert "skew=true" in plan(joined)


def reads(df) -> int:
    """How often the payments are read."""
    return sum("FileScan" in line and "status" in line for line in plan(df).splitlines())


def test_each_table_reads_the_payments_as_rarely_as_it_can(spark, skewed, lookup):
    p, s = tables.read_payments(spark, skewed), lookup
    assert reads(features.amount_mix(p, s, CFG)) == 1
    assert reads(features.payer_features_all(p, s, CFG, include_type_shares=True)) == 2
    assert reads(shares.schedule_distincts(p, s, CFG)) == 1


def test_ids_are_shuffled_once(spark, skewed, lookup):
    p, s = tables.read_payments(spark, skewed), lookup
    for df in (shares.schedule_distincts(p, s, CFG), shares.type_shares(s, p, CFG)):
        keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan(df))
        # by company, kind and id; afterwards only by company or company and type
        assert sum(len(k.split(",")) >= 3 for k in keys) == 1


def test_building_a_query_starts_no_job(spark, skewed):
    p, s = tables.read_payments(spark, skewed), segments(spark, *range(200))
    context = spark.sparkContext
    context.setJobGroup("building", "")
    try:
        for build in (
            lambda: features.payer_features(p, s, CFG),
            lambda: features.payer_features_all(p, s, CFG, True, True),
            lambda: features.amount_mix(p, s, CFG),
            lambda: shares.schedule_shares(shares.schedule_distincts(p, s, CFG)),
            lambda: shares.type_share_pivot(s, p, CFG),
            lambda: filters.with_segment(filters.eligible(p, CFG), s),
        ):
            build()
        assert list(context.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
