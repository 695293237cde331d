"""Model fits: quality on known data, determinism, shapes (rows-only ops)."""

import math

import pytest
from pyspark.sql import functions as F

from podium.operators import metrics as M
from podium.plans import models as ML
from podium.plans import studies as ST


@pytest.fixture(scope="module")
def separable(spark):
    rows = [(i, i % 10, float(i % 2) * 3.0 + (i % 7) * 0.01, float(i % 5), i % 2) for i in range(400)]
    return spark.createDataFrame(rows, "rid int, period int, x1 double, x2 double, y int")


@pytest.mark.parametrize("name", ["logreg_l2", "logreg_elasticnet", "linear_svm_calibrated", "rf", "hgb"])
def test_separable_auc_is_one(spark, separable, name):
    spec = ML.model_grid([name], rf={"num_trees": 10, "max_depth": 4}, hgb={"max_iter": 5, "max_depth": 3})[0]
    fm = ML.fit_model(separable, ["x1", "x2"], "y", spec)
    scored = fm.score(separable)
    assert M.roc_auc(scored, "score", "y").first().auc == pytest.approx(1.0)
    lo, hi = scored.agg(F.min("score"), F.max("score")).first()
    if name != "hgb":
        assert 0.0 <= lo <= hi <= 1.0


def test_shuffled_labels_near_half(spark):
    rows = [(i, float((i * 7919) % 101), (i * 104729) % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "rid int, x double, y int")
    fm = ML.fit_model(df, ["x"], "y", ML.model_grid(["logreg_l2"])[0])
    auc = M.roc_auc(fm.score(df), "score", "y").first().auc
    assert abs(auc - 0.5) < 0.1


def test_same_seed_same_result(spark, separable):
    spec = ML.model_grid(["rf"], rf={"num_trees": 5, "max_depth": 3})[0]
    a = ML.fit_model(separable, ["x1", "x2"], "y", spec).score(separable).orderBy("rid").collect()
    b = ML.fit_model(separable, ["x1", "x2"], "y", spec).score(separable).orderBy("rid").collect()
    assert [r.score for r in a] == [r.score for r in b]


def test_scaler_matches_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    sc = ML.Scaler.fit(df, ["a", "c"])
    assert sc.scale == {"a": 1.0, "c": 1.0} and sc.mean == {"a": 2.0, "c": 5.0}
    df2 = spark.createDataFrame([(1.0,), (5.0,)], "a double")
    assert ML.Scaler.fit(df2, ["a"]).scale["a"] == 2.0


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    w = {r.y: r.weight for r in ML.class_weights(df, "y").collect()}
    assert w == {1: 2.0, 0: 4 / 6}


def test_linear_coefficients_and_select_family(spark, separable):
    fm = ML.fit_model(separable, ["x1", "x2"], "y", ML.model_grid(["logreg_l2"])[0])
    co = ML.linear_coefficients(fm).collect()
    assert co[0].feature == "x1" and co[0].coef > 0
    sc = spark.createDataFrame([("a", "baseline", 0.5), ("a", "tree", 0.5), ("b", "baseline", 0.2), ("b", "tree", 0.9)],
                               "award string, family string, score double")
    got = {r.award: r.family for r in ST.select_family(sc).collect()}
    assert got == {"a": "baseline", "b": "tree"}


def test_permutation_importance_and_rolling_eval(spark, separable):
    fm = ML.fit_model(separable, ["x1", "x2"], "y", ML.model_grid(["logreg_l2"])[0])
    imp = {r.feature: r.importance_mean for r in ST.permutation_importance(fm, separable, "y", "rid").collect()}
    assert imp["x1"] > 0.2 and abs(imp["x2"]) < 0.2
    ranks, summary = ST.rolling_eval(separable, ["x1", "x2"], "y", "period", ["rid"], ML.model_grid(["logreg_l2"])[0],
                                     first_period=8)
    s = summary.first()
    # period 8 has no positive; period 9 has 40 of them
    assert s.seasons == 1 and s.top1 is not None


def test_learning_curve_and_sweep(spark, separable):
    lc = ST.learning_curve(separable, ["x1", "x2"], "y", "period", separable.where("period >= 8"),
                           ML.model_grid(["logreg_l2"])[0], fracs=(0.2, 1.0)).collect()
    st = {r.frac: r.status for r in lc}
    assert st == {0.2: "too_few_periods", 1.0: "ok"}
    sw = ST.hparam_sweep(separable.where("period < 8"), separable.where("period >= 8"), ["x1", "x2"], "y",
                         Cs=(0.1, 1.0)).collect()
    assert len(sw) == 2 and all(math.isclose(r.val_auc_mean, 1.0) for r in sw)


def test_svm_folds_are_stratified_and_few_rows_are_refused(spark):
    rows = [(i, float(i % 2), float(i % 5), int(i < 4)) for i in range(200)]
    few = spark.createDataFrame(rows, "rid int, x1 double, x2 double, y int")
    fm = ML.fit_model(few, ["x1", "x2"], "y", ML.linear_svm_calibrated())
    assert len(fm.calibrators) == 3  # each fold has one of the four positives or more
    with pytest.raises(ValueError):
        ML.fit_model(few.where("rid > 1"), ["x1", "x2"], "y", ML.linear_svm_calibrated())


def _award_facts(spark):
    rows = [(p * 100 + e, e, p, 20 + e % 5, float(400 + 40 * e + p), int(e == 9), int(e == 3 and p > 2),
             min(1.0, (e + 1) / 10), (e * 7 % 10) / 10.0) for p in range(1, 13) for e in range(10)]
    return spark.createDataFrame(rows, "__row_id long, Player long, season int, G int, MP double, mvp int, never int, "
                                       "pct_MP double, pct_G double").withColumn("never", F.lit(0))


def test_train_awards_save_load_and_predict(spark, tmp_path):
    from podium.plans import training as TR
    facts = _award_facts(spark)
    specs = ML.model_grid(["logreg_l2", "gbt_600"], gbt_600={"max_iter": 5})
    rows, fitted = TR.train_awards(facts, {"mvp": "mvp", "dpoy": "never"}, specs,
                                   eligibility={"mvp": {"mpg_min": 0}, "dpoy": {"mpg_min": 0, "g_min": 0}})
    got = {(r.award, r.model): r for r in rows.collect()}
    assert len(got) == 4 and set(fitted) == {("mvp", "logreg_l2"), ("mvp", "gbt_600")}
    assert {got["dpoy", m].status for m in ("logreg_l2", "gbt_600")} == {"single_class"}
    ok = got["mvp", "logreg_l2"]
    assert (ok.status, ok.n_train, ok.pos_train, ok.n_val, ok.n_test) == ("ok", 60, 6, 30, 30)
    assert ok.test_auc == pytest.approx(1.0) and ok.test_hit_at_1 == 1.0 and 0 < ok.test_logloss < 1
    assert got["dpoy", "gbt_600"].test_auc is None

    TR.save_run(fitted, str(tmp_path), "20230101_000000")
    TR.save_run(fitted, str(tmp_path), "20240101_000000")
    TR.save_run({("mvp", "logreg_l2"): fitted["mvp", "logreg_l2"]}, str(tmp_path), "not_a_run")
    loaded = TR.load_newest(spark, str(tmp_path))
    assert set(loaded) == {"mvp"} and set(loaded["mvp"]) == {"linear", "tree"}
    last = facts.where("season = 12")
    a = {r.Player: r.score for r in fitted["mvp", "logreg_l2"].score(last).collect()}
    b = {r.Player: r.score for r in loaded["mvp"]["linear"].score(last).collect()}
    assert a == b
    out, choice = TR.predict_from_newest(spark, str(tmp_path), facts.where("season < 12"), last, 12,
                                         out_path=f"{tmp_path}/out", eligibility={"mvp": {"mpg_min": 0}})
    assert out.where("rank = 1").first().Player == 9
    assert spark.read.parquet(f"{tmp_path}/out/audit").count() == 2

    values = TR.explain(fitted["mvp", "logreg_l2"], last, "mvp", "__row_id").collect()
    assert {r.feature for r in values} == {"pct_MP", "pct_G"}
    assert {r.std is None for r in TR.explain(fitted["mvp", "gbt_600"], last, "mvp", "__row_id", top_n=1).collect()} == {False}


def test_studies_refuse_a_single_class(spark, separable):
    one = separable.withColumn("y", F.lit(0))
    with pytest.raises(ValueError):
        ST.hparam_sweep(one, one, ["x1"], "y", Cs=(1.0,))


def test_permuted_parts_are_permutations(spark):
    from collections import Counter

    from podium.plans import studies as ST
    df = spark.createDataFrame([(i, float(i % 7), i * 3, "t") for i in range(200)], "id long, x double, y long, part string")
    got = ST.permuted_rows(df, ["x", "y"], "id", 2, 5).select("part", "row.*").collect()
    given = [tuple(r) for r in df.collect()]
    for part in range(4):
        rows = sorted(tuple(r)[1:] for r in got if r.part == part)
        f = 1 + part // 2
        assert Counter(r[f] for r in rows) == Counter(r[f] for r in given)
        assert [(*r[:f], *r[f + 1:]) for r in rows] == [(*r[:f], *r[f + 1:]) for r in given]
        assert sum(a[2] != b[2] for a, b in zip(rows, given)) > 150 or f == 1
    orders = {tuple(r.c2 for r in sorted((r for r in got if r.part == p), key=lambda r: r.c0)) for p in (2, 3)}
    assert len(orders) == 2


def test_fits_side_by_side_are_those_one_by_one(spark):
    from podium.plans import studies as ST
    assert ST.side_by_side(spark, [lambda i=i: spark.range(i).count() for i in range(6)], 3) == list(range(6))
    with pytest.raises(ZeroDivisionError):
        ST.side_by_side(spark, [lambda: 1 // 0, lambda: 2], 2)
