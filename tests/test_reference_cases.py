"""The reference's own test cases (FIXTURES.md part A) on Spark."""

import pytest

from podium.functions.names import infer_percentile_cols, is_leakage_feature
from podium.operators import eligibility as E
from podium.operators import leakage as L
from podium.operators import metrics as M


def test_a1_leak_name_raises(spark):
    df = spark.createDataFrame([(10.0, 0.0, 0), (20.0, 0.1, 0), (30.0, 0.9, 1)], "pts double, mvp_share double, y int")
    with pytest.raises(L.LeakageError):
        L.check_leakage(df, "y", "mvp", strict=True)


def test_a2_clean_names_pass(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0.0, 0), (3.0, 6.0, 1.0, 0), (7.0, 10.0, 2.0, 1)],
                               "ast double, trb double, stl double, y int")
    assert L.check_leakage(df, "y", "mvp", strict=True) == []


def _report(spark, rows):
    df = spark.createDataFrame(rows, "season int, score double, y int, rid int")
    return M.ranking_report(df, "season", "score", "y", ["rid"]).first()


@pytest.mark.parametrize("mode", ["small", "distributed"])
def test_a3_winners_first(spark, mode, request):
    if mode == "distributed":
        request.getfixturevalue("distributed")
    r = _report(spark, [(2024, .1, 0, 0), (2024, .2, 0, 1), (2024, .9, 1, 2),
                        (2025, .8, 1, 3), (2025, .4, 0, 4), (2025, .3, 0, 5)])
    assert (r.n_periods, r.hit_at_1, r.hit_at_5, r.mrr, r.mean_winner_rank) == (2, 1.0, 1.0, 1.0, 1.0)


def test_a4_season_without_winner_ignored(spark):
    r = _report(spark, [(2024, .9, 0, 0), (2024, .1, 0, 1), (2025, .2, 1, 2), (2025, .8, 0, 3)])
    assert (r.n_periods, r.hit_at_1, r.hit_at_5, r.mrr, r.mean_winner_rank) == (1, 0.0, 1.0, 0.5, 2.0)


def test_empty_report(spark):
    r = _report(spark, [(2024, .9, 0, 0)])
    assert (r.n_periods, r.hit_at_1, r.hit_at_5, r.mrr, r.mean_winner_rank) == (0, 0.0, 0.0, 0.0, None)


def test_a5_bench_filter(spark):
    df = spark.createDataFrame([("A", 80, 5, 2000.0), ("B", 80, 60, 2400.0), ("C", 80, 0, 1500.0)],
                               "Player string, G int, GS int, MP double")
    got = sorted(r.Player for r in E.apply_eligibility(df, "smoy").collect())
    assert got == ["A", "C"]


def test_a6_improvement_filter(spark):
    df = spark.createDataFrame([("Rookie", 1, 82, 2500.0, 2000.0), ("LowMP", 0, 82, 500.0, 2000.0),
                                ("OK", 0, 82, 2500.0, 2000.0)],
                               "Player string, is_rookie int, G int, MP double, prev_MP double")
    assert [r.Player for r in E.apply_eligibility(df, "mip").collect()] == ["OK"]


def test_a7_percentile_names():
    cols = ["pct_ts", "fg_pctile", "ast_percentile", "random_feature", "MP", "winner", "mvp_share",
            "pct_is_mvp_winner"]
    got = infer_percentile_cols(cols)
    assert {"pct_ts", "fg_pctile", "ast_percentile"} <= set(got)
    assert not ({"random_feature", "MP", "winner", "mvp_share", "pct_is_mvp_winner"} & set(got))


def test_a8_leak_names():
    for c in ["is_mvp_winner", "winner", "pct_is_mvp_winner"]:
        assert is_leakage_feature(c)
    for c in ["pts", "pct_ts"]:
        assert not is_leakage_feature(c)
