"""Correlations by vector aggregation, the leakage gate on a write, pushed double filters."""
import math
import os

import numpy as np
import pandas as pd
import pytest

from podium.operators import aggregate as G
from podium.operators import joins as J
from podium.operators import leakage as L
from podium.sources import readers as R


def _frame(spark, n=400, k=5, missing=0.2):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(2000, 5, (n, k)), columns=[f"c{i}" for i in range(k)])
    pdf["c1"] = pdf["c0"] * 2 + rng.normal(0, 1, n)
    gaps = pdf.mask(rng.random((n, k)) < missing)
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in gaps.itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(k))), gaps


@pytest.mark.parametrize("complete", [True, False])
def test_correlations_match_pandas(spark, complete):
    df, gaps = _frame(spark)
    want = (gaps.dropna() if complete else gaps).corr()
    got = G.correlation_matrix(df, list(gaps.columns), complete).collect()
    assert [(r.col_a, r.col_b) for r in got] == [(a, b) for i, a in enumerate(gaps) for b in list(gaps)[:i]]
    assert all(abs(r.corr - want.loc[r.col_a, r.col_b]) < 1e-10 for r in got)


@pytest.mark.parametrize("complete", [True, False])
def test_correlations_of_constant_empty_and_single(spark, complete):
    rows = [(0.1, float(i), None if i else 3.0, float(i % 3), float("inf") if i == 7 else 1.0 * i) for i in range(50)]
    df = spark.createDataFrame(rows, "const double, x double, once double, y double, wild double")
    got = {(r.col_a, r.col_b): r.corr for r in G.correlation_matrix(df, ["const", "x", "y", "wild"], complete).collect()}
    x, y = np.arange(50.0), np.arange(50) % 3
    assert abs(got["y", "x"] - np.corrcoef(x, y)[0, 1]) < 1e-12
    assert all(v is None for k, v in got.items() if "const" in k or "wild" in k)
    assert [r.corr for r in G.correlation_matrix(df, ["x", "once"], complete).collect()] == [None]
    assert [r.corr for r in G.correlation_matrix(df.limit(0), ["x", "y"], complete).collect()] == [None]
    assert G.correlation_matrix(df, ["x"], complete).collect() == []


def test_three_hundred_columns(spark):
    df, gaps = _frame(spark, n=300, k=300, missing=0.0)
    got = {(r.col_a, r.col_b): r.corr for r in G.correlation_matrix(df, list(gaps.columns)).collect()}
    want = gaps.corr().to_numpy()
    assert len(got) == 300 * 299 // 2
    assert all(abs(v - want[int(a[1:]), int(b[1:])]) < 1e-10 for (a, b), v in got.items())
    found = {r.feature: r.corr for r in L.feature_label_corr(df, "c0").collect()}
    assert len(found) == 299 and all(abs(v - want[0, int(c[1:])]) < 1e-10 for c, v in found.items())
    assert [r.feature for r in L.corr_leakage(df, "c0").collect()] == ["c1"]


def test_gate_rides_on_the_write(spark, tmp_path):
    rows = [(i, float(i % 7), i % 2, "train" if i < 60 else "test", float(i % 2) if i < 60 else 0.5) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, x double, y int, split string, copy double")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    seen = df.mapInArrow(counted, df.schema)
    options = {"cols": ["x", "copy"], "split_col": "split"}
    assert L.write_checked(seen, f"{tmp_path}/kept", "y", "mvp", strict=False, **options) == [
        ("corr", "copy", pytest.approx(1.0))]
    assert read.value == 90  # one pass for check and write
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 90
    assert L.check_leakage(df, "y", "mvp", strict=False, **options) == [("corr", "copy", pytest.approx(1.0))]
    with pytest.raises(L.LeakageError, match=r"award=mvp[\s\S]*copy=1.000"):
        L.write_checked(df, f"{tmp_path}/gone", "y", "mvp", **options)
    assert not os.path.exists(f"{tmp_path}/gone")
    with pytest.raises(L.LeakageError, match="mvp_share"):
        L.write_checked(df.withColumnRenamed("x", "mvp_share"), f"{tmp_path}/names", "y", "mvp")
    assert not os.path.exists(f"{tmp_path}/names")
    assert L.write_checked(df, f"{tmp_path}/test", "y", "mvp", cols=["x", "copy"], split_col="split", split="test") == []
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        L.write_checked(df, f"{tmp_path}/test", "y", "mvp", cols=["x"])
    assert L.write_checked(df.limit(0), f"{tmp_path}/empty", "y", "mvp", cols=["x", "copy"]) == []


def test_double_filters_reach_parquet(spark, tmp_path):
    values = [math.nan, None, 1.0, 5.0, -2.0, math.inf]
    spark.createDataFrame(list(enumerate(values)), "id int, value double").write.parquet(f"{tmp_path}/t")
    for op, want in ((">", {3, 5}), (">=", {3, 5}), ("<", {4}), ("<=", {2, 4}), ("=", {2})):
        c = 1.0 if op in ("<", "<=", "=") else 2.0
        got = R.read_facts(spark, f"{tmp_path}/t", ["id"], where=[("value", op, c)])
        assert {r.id for r in got.collect()} == want, op
    big = R.read_facts(spark, f"{tmp_path}/t", where=[("value", ">", 2.0)])
    plan = J.semi_filter(spark.range(9), "id", big, "id")._jdf.queryExecution().toString()
    assert "GreaterThan(value,2.0)" in plan
