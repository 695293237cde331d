"""Sources and sinks: snapshots, runs, CSV, fallbacks, writers."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from podium.sources import readers as R
from podium.sources import writers as WR
from podium.sources.tables import user_day


def test_snapshots_latest_and_named(spark):
    d = tempfile.mkdtemp(prefix="podium-snap-")
    ud = user_day(spark, "/root/testdata/sf0.001")
    WR.write_snapshots(ud, d, "period", [("2024-01-10", 9), ("2024-01-20", 19), ("2024-01-30", 29)])
    latest = R.read_latest_snapshot(spark, d)
    assert latest.agg(F.max("period")).first()[0] == 29
    named = R.read_latest_snapshot(spark, d, "asof_2024-01-10")
    assert named.agg(F.max("period")).first()[0] == 9
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "asof" in plan


def test_latest_runs(spark):
    runs = spark.createDataFrame([("mvp", "20240101_120000", 1), ("mvp", "20240102_120000", 2),
                                  ("roy", "20240101_120000", 3), ("roy", "latest", 4)],
                                 "award string, run_id string, v int")
    got = sorted((r.award, r.v) for r in R.latest_runs(runs).collect())
    assert got == [("mvp", 2), ("roy", 3)]


def test_first_existing_and_csv(spark):
    d = tempfile.mkdtemp(prefix="podium-src-")
    spark.createDataFrame([(1, 2.0)], "a int, b double").write.parquet(os.path.join(d, "second"))
    df = R.read_first_existing(spark, [os.path.join(d, "missing"), os.path.join(d, "second")])
    assert df.count() == 1
    with pytest.raises(FileNotFoundError):
        R.read_first_existing(spark, [os.path.join(d, "nope")])
    p = os.path.join(d, "rookies.csv")
    with open(p, "w") as f:
        f.write("Player\n A \nB\n")
    assert [r.Player for r in R.read_csv_table(spark, p, "Player string").collect()] == [" A ", "B"]


def test_write_predictions_and_run(spark):
    d = tempfile.mkdtemp(prefix="podium-out-")
    sc = spark.createDataFrame([("mvp", 1, 0.9), ("mvp", 2, 0.5), ("roy", 1, 0.7)], "award string, rank long, score double")
    WR.write_predictions(sc, d, top_k=1)
    assert spark.read.parquet(f"{d}/all").count() == 3
    assert spark.read.option("header", True).csv(f"{d}/top1").count() == 2
    m = spark.createDataFrame([("mvp", 0.8)], "award string, val_auc double")
    WR.write_run(m, None, d, "20240101_000000")
    back = R.read_latest_run(spark, f"{d}/metrics", fmt="json")
    assert back.count() == 1


def test_award_datasets_partitioned_and_audit(spark):
    d = tempfile.mkdtemp(prefix="podium-aw-")
    df = spark.createDataFrame([("mvp", 1, 0.5, 1), ("roy", 2, 0.1, 0), ("mvp", 3, 0.2, 0)],
                               "award string, rid int, x double, y int")
    WR.write_award_datasets(df, d)
    back = spark.read.parquet(d).where(F.col("award") == "mvp")
    assert sorted(r.rid for r in back.collect()) == [1, 3]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    sc = spark.createDataFrame([("mvp", "baseline", 0.4), ("mvp", "tree", 0.9), ("roy", "baseline", 0.3)],
                               "award string, family string, score double")
    from podium.plans.studies import select_family
    audit = {(r.award, r.family): (r.top1_score, r.chosen, r.season_label)
             for r in WR.prediction_audit(sc, select_family(sc), "asof=2026-01-26", 2026).collect()}
    assert audit == {("mvp", "baseline"): (0.4, 0, "2025-26"), ("mvp", "tree"): (0.9, 1, "2025-26"),
                     ("roy", "baseline"): (0.3, 1, "2025-26")}
