from __future__ import annotations

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from build import CFG, pay, payments, segments
from paysegments.config import slug
from paysegments.functions import lineage
from paysegments.plans import features, segmentation
from paysegments.sources import star, tables

SMALL = "/root/testdata/sf0.001"


def test_round_trip(spark, tmp_path):
    p = payments(spark, pay(1, "2024-07-01"), pay(2, None, amount=None))
    path = str(tmp_path / "payments")
    p.withColumn("extra", F.lit(1)).write.parquet(path)
    back = tables.read_payments(spark, path)
    assert back.columns == tables.PAYMENTS.names
    assert sorted(back.collect()) == sorted(p.collect())
    assert "extra" not in back._jdf.queryExecution().executedPlan().toString()


def test_catalog_table(spark):
    segments(spark, 1, (2, None)).createOrReplaceTempView("owners")
    assert tables.read_segments(spark, "owners", "table").count() == 2


def test_wrong_columns_are_named(spark, tmp_path):
    path = str(tmp_path / "segments")
    spark.sql("SELECT 1 AS company_id").write.parquet(path)
    with pytest.raises(ValueError, match="company_id: expected bigint, found int; segment: .* nothing"):
        tables.read_segments(spark, path)


def test_slug():
    assert slug("Condo & MCST fees") == "condo_mcst_fees"


def test_intermediate_tables_go_where_the_session_says(spark):
    assert lineage.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    with lineage.Scratch(spark) as scratch:
        table = scratch.write(spark.range(3))
        [path] = [p for _, p in scratch.paths.values()]
        assert path.startswith(lineage.shared_folder(spark)) and os.path.isdir(path)
        assert table.count() == 3
    assert not os.path.exists(path)


def test_without_a_checkpoint_folder_they_go_to_the_warehouse():
    class Session:
        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)
            master = "local"

        class conf:
            get = staticmethod(lambda key, *default: "/w" if key == "spark.sql.warehouse.dir" else default[0])

    assert lineage.shared_folder(Session) == "/w/intermediate"


@pytest.fixture
def star_files(spark, tmp_path):
    """The star tables of the smallest size, with one part missing."""
    for name in star.SCHEMAS:
        spark.read.parquet(f"{SMALL}/{name}.parquet").where("true" if name != "part" else "p_partkey <> 7").write.parquet(
            str(tmp_path / f"{name}.parquet")
        )
    return tmp_path


def test_an_item_of_an_unknown_part_is_a_payment_without_type(spark, star_files):
    whole = star.payments(spark, SMALL)
    found = star.payments(spark, str(star_files))
    assert found.count() == whole.count()
    lost = spark.read.parquet(f"{SMALL}/lineitem.parquet").where("l_partkey = 7").count()
    assert found.where("payment_type IS NULL").count() == lost > 0


def test_a_missing_column_is_named(spark, star_files):
    path = str(star_files / "customer.parquet")
    spark.read.parquet(f"{SMALL}/customer.parquet").drop("c_acctbal").write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="c_acctbal: expected double, found nothing"):
        star.segments(spark, str(star_files))


def test_the_readers_with_all_payment_types(spark, tmp_path):
    """Written files, the full list of types and the numeric locale, against the same rules in SQL."""
    draw = random.Random(3)
    types = [*CFG.payment_types, "Gold", None]
    rows = [
        pay(
            draw.randrange(30),
            f"20{draw.randrange(22, 25)}-{draw.randrange(1, 13):02d}-{draw.randrange(1, 28):02d}",
            payment_id=draw.randrange(400),
            payment_type=draw.choice(types),
            status=draw.choice(["Success", "Success", "Refunded", None]),
            user_type=draw.choice(["business", "guest", "staff"]),
            locale_id=draw.choice([1, 1, 2]),
            amount=draw.randrange(-5, 500),
        )
        for _ in range(3000)
    ]
    payments(spark, *rows).write.parquet(str(tmp_path / "payments"))
    segments(spark, *range(25), (3, "other"), *[(c, "other") for c in range(25, 30)]).write.parquet(str(tmp_path / "segments"))
    p, s = tables.read_payments(spark, str(tmp_path / "payments")), tables.read_segments(spark, str(tmp_path / "segments"))
    found = sorted(tuple(r) for r in features.amount_mix(p, s, CFG).collect())
    listed = ", ".join(f"'{t}'" for t in CFG.excluded_statuses)
    cells = ", ".join(f"max(CASE WHEN payment_type = '{t}' THEN amount ELSE 0 END)" for t in CFG.payment_types)
    con = duckdb.connect()
    expected = con.execute(f"""
        WITH p AS (SELECT * FROM '{tmp_path}/payments/*.parquet'),
        m AS (SELECT company_id, payment_type, date_trunc('month', paid_at) AS month, sum(amount) AS amount,
                count(DISTINCT payment_id) AS n FROM p
              WHERE status NOT IN ({listed}) AND user_type IN ('business', 'guest') AND locale_id = 1
                AND CAST(paid_at AS DATE) BETWEEN DATE '2023-09-01' AND DATE '2024-08-31'
                AND company_id IN (SELECT company_id FROM '{tmp_path}/segments/*.parquet' WHERE segment = 'own')
              GROUP BY ALL),
        t AS (SELECT company_id, payment_type, sum(amount) AS amount, sum(n) AS n FROM m GROUP BY ALL)
        SELECT company_id, {cells}, sum(amount), CAST(sum(n) AS BIGINT) FROM t
        WHERE company_id IN (SELECT company_id FROM p WHERE CAST(paid_at AS DATE) >= DATE '2024-06-01')
        GROUP BY company_id ORDER BY company_id""").fetchall()
    assert len(found) > 20 and found == expected


# --- intermediate tables -----------------------------------------------------------------


def _table(spark, folder, rows):
    spark.createDataFrame(rows, "id long, v double").write.mode("overwrite").parquet(str(folder))
    return lambda: spark.read.parquet(str(folder)).where("v > 1").groupBy("id").sum("v")


def test_a_stored_table_is_computed_once(spark, tmp_path):
    kept, built = lineage.Store(), []

    def ask(source, step="sum"):
        def build():
            built.append(step)
            return source

        return sorted(tuple(r) for r in kept.get([source], step, build).collect())

    read = _table(spark, tmp_path / "t", [(1, 2.0), (2, 3.0), (2, 0.5)])
    assert ask(read()) == ask(read()) == [(1, 2.0), (2, 3.0)]
    assert built == ["sum"]
    # another constant, another step and another input are other tables
    ask(spark.read.parquet(str(tmp_path / "t")).where("v > 2").groupBy("id").sum("v"))
    ask(read(), "other")
    assert built == ["sum", "sum", "other"]
    again = _table(spark, tmp_path / "t", [(1, 7.0)])
    assert ask(again()) == [(1, 7.0)] and len(built) == 4


def test_nothing_is_left_after_release(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "shared_folder", lambda _: str(tmp_path / "shared"))
    table = lineage.materialise(spark.range(10).withColumnRenamed("id", "n"))
    assert table.count() == 10 and list((tmp_path / "shared").rglob("*.parquet"))
    lineage.release(spark)
    assert not [p for p in (tmp_path / "shared").rglob("*") if p.is_file()]


def test_features_are_computed_once(spark):
    p, s = (build(spark, "/root/testdata/sf0.001") for build in (star.payments, star.segments))
    first = segmentation.scaled_features(p, s, star.STAR)
    p, s = (build(spark, "/root/testdata/sf0.001") for build in (star.payments, star.segments))
    context = spark.sparkContext
    context.setJobGroup("again", "")
    again = segmentation.scaled_features(p, s, star.STAR)
    jobs = context.statusTracker().getJobIdsForGroup("again")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert again.inputFiles() == first.inputFiles() and len(jobs) <= 4  # listing the inputs


@pytest.mark.parametrize(
    "master, warehouse, fine",
    [
        ("local", "file:/w", True),
        ("local[8]", "/w", True),
        ("local-cluster[3,2,1000]", "file:/w", True),
        ("spark://host:7077", "file:/w", False),
        ("yarn", "/w", False),
        ("yarn", "hdfs://name/w", True),
        ("k8s://host", "s3a://place/w", True),
    ],
)
def test_a_warehouse_that_executors_do_not_share_is_refused(monkeypatch, master, warehouse, fine):
    class Conf:
        def get(self, name, *default):
            return warehouse if name == "spark.sql.warehouse.dir" else None

    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    Session.sparkContext.master = master
    monkeypatch.setattr(lineage, "_default_scheme", lambda spark: "file")
    if fine:
        assert lineage.shared_folder(Session()) == f"{warehouse}/intermediate"
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            lineage.shared_folder(Session())
