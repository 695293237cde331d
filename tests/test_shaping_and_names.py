"""Schema shaping, name rules and the small builders."""

import pytest

from podium.functions import names as N
from podium.operators import leakage as L
from podium.operators import shaping as P
from podium.plans import datasets as B


def test_normalize_schema_renames_and_parses(spark):
    df = spark.createDataFrame([("a", "X", "2025-26"), ("b", "Y", "bad"), ("c", "Z", "1999-00")],
                               "Player string, Team string, year string")
    out = P.normalize_schema(df)
    assert out.columns == ["Player", "Tm", "season"]
    assert sorted((r.Player, r.season) for r in out.collect()) == [("a", 2026), ("c", 2000)]


def test_feature_sets_and_unknown_name():
    cols = ["pct_PTS", "PTS_pct", "pct_mvp_share", "Pos", "G"]
    fs = N.feature_set("baseline", cols)
    assert fs.name == "baseline_pct_only" and fs.numeric == ["PTS_pct", "pct_PTS"] and fs.categorical == ["Pos"]
    assert N.feature_set("tree", cols).name == "tree_pct_only"
    with pytest.raises(ValueError):
        N.feature_set("mip", cols)
    assert N.resolve(cols, ["G", "nope", "G", "Pos"]) == ["G", "Pos"]


def test_notebook_rules_groups_and_audit():
    cols = ["mvp_rank", "is_rookie", "all_nba_team", "has_mvp_consideration", "pct_is_mvp_winner", "Player",
            "teams_list", "Team", "pct_PTS", "age", "raptor_total", "pts_pctile"]
    assert N.leak_pattern_filter(cols) == ["mvp_rank", "is_rookie", "all_nba_team", "has_mvp_consideration",
                                           "pct_is_mvp_winner", "Player", "teams_list", "Team"]
    g = N.feature_groups(cols)
    assert g["bio"] == ["age"] and g["external_metrics"] == ["raptor_total"]
    assert g["percentiles"] == ["pts_pctile"]  # D9: the pct_ prefix is not in the reference's group
    assert "pct_PTS" in N.feature_groups(cols, N.FEATURE_GROUPS_CORRECTED)["percentiles"]
    assert N.forbidden_substring_audit(["pts", "mvp_share", "ballots"]) == ["mvp_share", "ballots"]
    assert N.external_metric_features(["pct_mamba__MAMBA", "x"], ["b"]) == ["b", "pct_mamba__MAMBA"]


def test_name_leakage_strict_tokens():
    # D8: "roy_votes" is not caught by the reference rule, the strict token list catches it
    assert N.name_leakage(["roy_votes", "dpoy_rank", "pts"]) == ["dpoy_rank"]
    assert N.name_leakage(["roy_votes", "dpoy_rank", "pts"], strict_tokens=True) == ["dpoy_rank", "roy_votes"]


def test_leakage_checked_on_train_split_only(spark):
    # A column that copies the label only in the test split is not a train-split leak
    rows = [("train", float(i % 3), i % 2) for i in range(40)] + [("test", float(i % 2), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "split string, x double, y int")
    assert L.check_leakage(df, "y", "mvp", split_col="split", strict=True) == []
    with pytest.raises(L.LeakageError):
        L.check_leakage(df, "y", "mvp", split_col="split", split="test", strict=True)


def test_one_hot_null_rules(spark):
    df = spark.createDataFrame([("G",), (None,), ("F",)], "Pos string")
    a = P.one_hot(df, "Pos").collect()
    assert sorted(P.one_hot(df, "Pos").columns) == ["Pos_F", "Pos_G", "Pos_UNK"]
    assert sum(r.Pos_UNK for r in a) == 1
    b = P.one_hot(df, "Pos", null_as=None)
    assert sorted(b.columns) == ["Pos_F", "Pos_G"]
    assert [tuple(r) for r in b.collect()][1] == (0, 0)


def test_build_clean_and_feature_matrices(spark):
    df = spark.createDataFrame([(1, "a", 2020, None, 1.0, 0.5), (2, "a", 2020, 3.0, 1.0, 0.5),
                                (3, "b", 2020, 4.0, None, None)],
                               "rid int, Player string, season int, pct_x double, mvp_rank double, "
                               "pct_raptor__raptor_total double")
    clean, leaks = B.build_clean(df, ["Player", "season"], "rid")
    got = {r.Player: r.rid for r in clean.collect()}
    assert got == {"a": 2, "b": 3} and leaks == ["mvp_rank"]
    era, modern = B.build_feature_matrices(clean, ["pct_x", "mvp_rank"], keep=["Player"])
    assert era.columns == ["Player", "pct_x"]
    assert modern.columns == ["Player", "pct_x", "pct_raptor__raptor_total"]


def test_normalize_importance_names(spark):
    df = spark.createDataFrame([("a", 0.1, 0.01), ("b", -0.3, 0.02)], "Feature string, importance_mean double, "
                                                                      "importance_std double")
    out = P.normalize_importance(df).collect()
    assert [(r.feature, r.value, r.std, r.abs_value) for r in out] == [("b", -0.3, 0.02, 0.3), ("a", 0.1, 0.01, 0.1)]


def test_names_fold_every_latin_accent(spark):
    from podium.operators.matching import entity_match, normalize_name
    want = {"Luka Dončić": "luka doncic", "Jokić": "jokic", "Jokič": "jokic", "Valančiūnas": "valanciunas", "Šarić": "saric",
            "Žižić": "zizic", "Āboliņš": "abolins", "Işık": "isik", "Łukasz Øster": "lukasz oster", "Đorđe": "dorde",
            "Straße Æon": "strasse aeon", "Nguyễn": "nguyen", "José  O'Neil-Jr.": "jose o neil jr", "İstanbul": "istanbul",
            "": "", None: None}
    df = spark.createDataFrame([(k, v) for k, v in want.items()], "name string, want string")
    got = {r["name"]: r.key for r in df.select("name", normalize_name("name").alias("key")).collect()}
    assert got == want
    right = spark.createDataFrame([(1, "Luka Doncic"), (2, "Jonas Valanciunas")], "id int, n string")
    left = spark.createDataFrame([(7, "Luka Dončić"), (8, "Jonas Valančiūnas")], "id int, n string")
    assert {(r.left_id, r.right_id) for r in entity_match(left, right, "n", "n", "id", "id").collect()} == {(7, 1), (8, 2)}


def test_worst_period_of_text_periods(spark):
    from podium.operators.topk import worst_period
    df = spark.createDataFrame([("2000-01", 3), ("1999-00", 5), ("2001-02", 5), ("2002-03", None)], "season string, r int")
    assert tuple(worst_period(df, "season", "r").first()) == ("1999-00", 5)
