"""Hand-made edge rows (FIXTURES.md part A, last paragraph)."""

import math

import pytest
from pyspark.sql import functions as F

from podium.functions import scalar as S
from podium.operators import aggregate as G
from podium.operators import eligibility as E
from podium.operators import joins as J
from podium.operators import leakage as L
from podium.operators import metrics as M
from podium.operators import windows as W
from podium.plans.models import MedianImputer


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "k int, x double")
    out = {r.k: r.x for r in S.nan_to_null(df).collect()}
    assert out == {1: None, 2: 3.0}


def test_null_entity_gets_null_lag(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), ("a", 1, 3.0), ("a", 2, 4.0)],
                               "e string, p int, x double")
    out = {(r.e, r.p): r.prev_x for r in W.add_prev_features(df, "e", "p", ["x"]).collect()}
    assert out[(None, 1)] is None and out[(None, 2)] is None
    assert out[("a", 2)] == 3.0


def test_lag_against_strict_previous(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 3.0), ("a", 4, 4.0)], "e string, p int, x double")
    lag = {r.p: r.prev_x for r in W.add_prev_features(df, "e", "p", ["x"]).collect()}
    strict = {r.p: r.prev_x for r in J.prev_period_join(df, "e", "p", ["x"]).collect()}
    assert lag == {1: None, 3: 1.0, 4: 3.0}
    assert strict == {1: None, 3: None, 4: 3.0}


def test_duplicate_key_raises(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1)], "e string, p int")
    with pytest.raises(ValueError):
        J.assert_unique_key(df, ["e", "p"])


@pytest.mark.parametrize("mode", ["small", "distributed"])
def test_ties_and_nulls_in_percentiles(spark, mode, request):
    if mode == "distributed":
        request.getfixturevalue("distributed")
    rows = [(1, i, float(v) if v is not None else None) for i, v in enumerate([5, 5, 5, 1, None, 9, 5, 1])]
    df = spark.createDataFrame(rows, "p int, k int, x double")
    got = {r.k: r.x_pct for r in W.percent_rank_avg(df, "p", "x").collect()}
    # non-null values: 1,1,5,5,5,5,9 -> average ranks 1.5, 4.5, 7 over 7
    assert got[4] is None
    assert math.isclose(got[3], 1.5 / 7) and math.isclose(got[0], 4.5 / 7) and math.isclose(got[5], 1.0)


@pytest.mark.parametrize("mode", ["small", "distributed"])
def test_rank_ties_broken_by_key_and_null_score(spark, mode, request):
    if mode == "distributed":
        request.getfixturevalue("distributed")
    df = spark.createDataFrame([(1, 3, 0.5), (1, 1, 0.5), (1, 2, 0.9), (1, 4, None)], "p int, k int, s double")
    got = {r.k: r.rank for r in W.rank_in_period(df, "p", "s", ["k"]).collect()}
    assert got == {2: 1, 1: 2, 3: 3, 4: None}


def test_period_with_two_winners_and_invalid_periods(spark):
    df = spark.createDataFrame([(1, 0.9, 1, 0), (1, 0.5, 1, 1), (1, 0.1, 0, 2), (2, 0.3, 0, 3), (2, 0.2, 1, 4)],
                               "p int, s double, y int, k int")
    r = M.ranking_report(df, "p", "s", "y", ["k"]).first()
    assert r.n_periods == 2 and r.mean_winner_rank == 1.5
    acc = M.topk_accuracy(df, "p", "s", "y", ["k"]).first()
    assert acc.n_winners == 3 and math.isclose(acc.mrr, (1 + 0.5 + 0.5) / 3)
    kept = {r.p for r in E.drop_invalid_periods(df, "p", "y").collect()}
    assert kept == {2}


def test_constant_column_correlation_is_null(spark):
    rows = [(1.0, float(i), i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "c double, x double, y int")
    cm = {(r.col_a, r.col_b): r.corr for r in G.correlation_matrix(df, ["c", "x"]).collect()}
    assert cm[("x", "c")] is None
    assert L.corr_leakage(df, "y", ["c", "x"]).count() == 0


def test_label_copy_is_found(spark):
    rows = [(float(i % 2), float(i), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "copy double, x double, y int")
    found = [(r.feature, r.corr) for r in L.corr_leakage(df, "y").collect()]
    assert [f for f, _ in found] == ["copy"] and math.isclose(found[0][1], 1.0)


def test_all_null_column_dropped_by_imputer(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    imp = MedianImputer.fit(df, ["a", "b"])
    assert imp.dropped == ["b"] and imp.medians == {"a": 2.0}
    assert imp.transform(df).columns == ["a"]


def test_single_class_auc_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert M.roc_auc(df, "s", "y").first().auc is None


@pytest.mark.parametrize("mode", ["small", "distributed"])
def test_auc_and_ap_with_ties(spark, mode, request):
    if mode == "distributed":
        request.getfixturevalue("distributed")
    s = [0.1, 0.4, 0.35, 0.8, 0.4, 0.4]
    y = [0, 0, 1, 1, 1, 0]
    df = spark.createDataFrame(list(zip(s, y)), "s double, y int")
    # brute force: pairs (pos, neg) with pos > neg count 1, ties 0.5
    pos = [a for a, b in zip(s, y) if b]
    neg = [a for a, b in zip(s, y) if not b]
    auc = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(M.roc_auc(df, "s", "y").first().auc, auc)
    # average precision by distinct thresholds, high to low
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp = sum(1 for a, b in zip(s, y) if a >= t and b)
        n = sum(1 for a in s if a >= t)
        r = tp / len(pos)
        ap += (r - prev_r) * tp / n
        prev_r = r
    assert math.isclose(M.average_precision(df, "s", "y").first().average_precision, ap)


def test_season_parsing(spark):
    df = spark.createDataFrame([("1999-00",), ("2025-26",), ("2025-2026",), ("2026",), ("abc",), ("",), (None,),
                                ("2025-27",)], "s string")
    got = [r.e for r in df.select(S.parse_season_end("s").alias("e")).collect()]
    assert got == [2000, 2026, 2026, 2026, None, None, None, 2027]
    lab = spark.range(1).select(S.season_label(F.lit(2026)).alias("l"), S.season_label(F.lit(2000)).alias("m")).first()
    assert (lab.l, lab.m) == ("2025-26", "1999-00")


def test_games_zero(spark):
    df = spark.createDataFrame([("a", 0, 0, 100.0), ("b", 10, 8, 100.0)], "Player string, G int, GS int, MP double")
    assert {r.Player for r in E.apply_eligibility(df, "smoy").collect()} == {"a"}
    mpg = {r.Player: r.m for r in E.per_game_minutes(df, "m").collect()}
    assert mpg["a"] is None and mpg["b"] == 10.0


@pytest.mark.parametrize("mode", ["small", "distributed"])
def test_per_game_switch_is_per_period(spark, mode, request):
    if mode == "distributed":
        request.getfixturevalue("distributed")
    # period 1: MP already per game (median MP/G < 3, median MP in [5, 45]); period 2: totals
    rows = [(1, "a", 30.0, 20), (1, "b", 20.0, 20), (1, "c", 10.0, 20),
            (2, "d", 2000.0, 80), (2, "e", 1000.0, 50), (2, "f", 300.0, 30)]
    df = spark.createDataFrame(rows, "season int, Player string, MP double, G int")
    got = {r.Player: r.m for r in E.per_game_minutes(df, "m", "season").collect()}
    assert got["a"] == 30.0 and got["c"] == 10.0
    assert got["d"] == 25.0 and got["f"] == 10.0


def test_roy_fallback_per_period(spark):
    rows = [(1, "a", 1), (1, "b", 0), (2, "c", 0), (2, "d", 0)]
    df = spark.createDataFrame(rows, "season int, Player string, is_rookie int")
    got = sorted(r.Player for r in E.apply_eligibility(df, "roy", "season").collect())
    assert got == ["a", "c", "d"]
    names = spark.createDataFrame([(" c ",), ("c",)], "Player string")
    got2 = sorted(r.Player for r in E.apply_eligibility(df, "roy", "season", rookies=names).collect())
    assert got2 == ["a", "c"]


def test_flag_members_overwrites(spark):
    df = spark.createDataFrame([("a ", 1), ("b", 1), ("c", 0)], "Player string, is_rookie int")
    lst = spark.createDataFrame([("a",), ("c",), ("c",)], "Player string")
    got = {r.Player: r.is_rookie for r in J.flag_members(df, lst).collect()}
    assert got == {"a ": 1, "b": 0, "c": 1}


def test_exact_median_interpolates(spark, distributed):
    from podium.operators.ordering import exact_quantiles
    df = spark.createDataFrame([(1, float(v)) for v in [1, 2, 4, 9]] + [(2, 5.0)], "g int, v double")
    got = {r.g: (r.q0, r.n) for r in exact_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {1: (3.0, 4), 2: (5.0, 1)}


def test_entity_match_exact_and_distance_one(spark):
    from podium.operators.matching import entity_match
    left = spark.createDataFrame([(1, "José"), (2, "Jon  Smith"), (3, "zzz"), (4, "Ann"), (5, "jose ")],
                                 "id int, n string")
    right = spark.createDataFrame([(10, "JOSE"), (11, "John Smith"), (12, "Anne"), (13, "Ana"), (9, "jose")],
                                  "id int, n string")
    got = {r.left_id: (r.right_id, r.distance) for r in entity_match(left, right, "n", "n", "id", "id", 1).collect()}
    # accents folded and blanks collapsed; equal keys -> lowest right id; ties at distance 1 -> lowest id
    assert got == {1: (9, 0), 2: (11, 1), 3: (None, None), 4: (12, 1), 5: (9, 0)}
    exact = {r.left_id: r.right_id for r in entity_match(left, right, "n", "n", "id", "id").collect()}
    assert exact == {1: 9, 2: None, 3: None, 4: None, 5: 9}


def test_seasons_count_periods_not_winners(spark):
    ranks = spark.createDataFrame([(1, 1), (1, 4), (2, 2)], "season int, rank long")
    r = M.winner_rank_summary(ranks, period_col="season").first()
    assert (r.seasons, r.median_rank, r.max_rank) == (2, 2.0, 4.0)
    by = M.winner_rank_summary(ranks.withColumn("award", F.lit("mvp")), group_cols=["award"], period_col="season").first()
    assert (by.award, by.seasons, by.median_rank) == ("mvp", 2, 2.0)


def test_an_empty_rookie_list_is_no_list(spark):
    df = spark.createDataFrame([(2000, "a", 0), (2000, "b", 0), (2001, "c", 1), (2001, "d", 0)],
                               "season int, Player string, is_rookie int")
    empty = spark.createDataFrame([], "Player string")
    got = sorted(r.Player for r in E.apply_eligibility(df, "roy", "season", rookies=empty).collect())
    assert got == ["a", "b", "c"]


def test_text_copies_of_the_label_are_leaks(spark):
    df = spark.range(200).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2).cast("string").alias("copy"),
                                 F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"),
                                 (F.col("id") % 7).cast("string").alias("other"))
    assert [r.feature for r in L.corr_leakage(df, "y").collect()] == ["copy"]
    assert ("corr", "copy") in {(r.kind, r.feature) for r in L.leakage_report(df, "y", "mvp").collect()}


def test_strict_previous_period_refuses_repeated_keys(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0)], "e string, p int, x double")
    with pytest.raises(Exception, match="duplicate key"):
        J.prev_period_join(df, "e", "p", ["x"]).collect()
    assert J.prev_period_join(df, "e", "p", ["x"], validate=False).count() == 2
    unknown = spark.createDataFrame([(None, 1, 1.0), (None, 1, 1.0)], "e string, p int, x double")
    assert [r.prev_x for r in J.prev_period_join(unknown, "e", "p", ["x"]).collect()] == [None, None]


def test_one_scan_for_previous_values(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "value")
    for out in (W.add_prev_features(df, "user_id", "ts", ["value"]),
                J.prev_period_join(df.withColumn("p", F.dayofyear("ts")), "user_id", "p", ["value"])):
        assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_names_match_within_two_edits(spark):
    from podium.operators.matching import entity_match
    left = spark.createDataFrame([(1, "Jon Smith"), (2, "Nikola Jokic"), (3, "Nobody Here"), (4, None), (5, "?!")], "i int, n string")
    right = spark.createDataFrame([(10, "John Smyth"), (11, "Nikola Jokic"), (12, "Nikola Joki")], "i int, n string")
    got = {r.left_id: (r.right_id, r.distance) for r in entity_match(left, right, "n", "n", "i", "i", max_distance=2).collect()}
    assert got == {1: (10, 2), 2: (11, 0), 3: (None, None), 4: (None, None), 5: (None, None)}
