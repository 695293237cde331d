import math
import random

import pytest

from podium.plans import models as ML
from podium.plans import prefix_stats as PX
from podium.plans import studies as ST

COLS = ["x", "cut", "feature", "flat", "late", "empty"]


def _rows(n_periods, per_period, rng):
    rows = []
    for p in range(n_periods):
        for _ in range(per_period):
            x = rng.choice([None, math.inf, math.nan, *[float(rng.randrange(6))] * 6])
            rows.append((p, x, 1e9 + rng.random(), rng.randrange(3) or None, 0.1, float(p) if p > 3 else None, None,
                         rng.randrange(2), "mine"))
    rows.append((None, 99.0, 99.0, 99, 99.0, 99.0, 99.0, 1, "mine"))
    return rows


SCHEMA = "season int, x double, cut double, feature int, flat double, late double, empty double, y int, __period string"


@pytest.mark.parametrize("inclusive", [False, True])
def test_every_prefix_has_the_statistics_of_its_own_fit(spark, distributed, inclusive):
    df = spark.createDataFrame(_rows(9, 23, random.Random(3)), SCHEMA).cache()
    cuts = [1, 4, 4, 8, 50]
    got = {(r["cut"], r.feature): r for r in PX.prefix_statistics(df, COLS, "season", cuts, inclusive).collect()}
    assert len(got) == 4 * len(COLS)
    ready = PX.prepare_prefixes(df, COLS, "y", "season", cuts, inclusive)
    for cut in set(cuts):
        part = df.where(f"season {'<=' if inclusive else '<'} {cut}")
        want = ML.prepare(part, COLS, "y")
        mine = ready.part(cut)
        assert mine.imputer.medians == want.imputer.medians and mine.imputer.dropped == want.imputer.dropped
        assert mine.features == want.features and mine.n_rows == want.n_rows
        for f in want.features:
            assert mine.scaler.mean[f] == pytest.approx(want.scaler.mean[f], rel=1e-12)
            assert mine.scaler.scale[f] == pytest.approx(want.scaler.scale[f], rel=1e-6)
        assert mine.scaler.scale["flat"] == 1.0
        gone = got[cut, "empty"]
        assert (gone.n_values, gone["median"], gone["mean"], gone["scale"]) == (0, None, None, None)
        assert sorted(map(str, mine.train.collect())) == sorted(map(str, want.train.collect()))
        want.release()
    ready.release()


def test_more_cuts_than_a_row_holds_and_text_periods(spark):
    n = 2 * PX.CUTS_PER_ROW + 5
    df = spark.createDataFrame([(f"{p:03d}", float(p * p % 17)) for p in range(n)], "season string, x double")
    got = {r["cut"]: r for r in PX.prefix_statistics(df, ["x"], "season", [f"{p:03d}" for p in range(n)]).collect()}
    for p in range(n):
        seen = sorted(float(q * q % 17) for q in range(p))
        r = got[f"{p:03d}"]
        assert r.n_rows == p
        if not seen:
            assert r["median"] is None
            continue
        assert r["median"] == (seen[(p - 1) // 2] + seen[p // 2]) / 2
        mean = sum(seen) / p
        sd = math.sqrt(sum((v - mean) ** 2 for v in seen) / p)
        assert r["mean"] == pytest.approx(mean) and r["scale"] == pytest.approx(sd or 1.0)


def test_no_cuts_no_rows_no_features(spark):
    df = spark.createDataFrame([(1, 2.0)], "season int, x double")
    assert PX.prefix_statistics(df, ["x"], "season", []).collect() == []
    assert PX.prefix_statistics(df, [], "season", [1]).collect() == []
    assert PX.prefix_statistics(df.limit(0), ["x"], "season", [1]).collect() == []


def test_walk_forward_and_learning_curve_match_fits_one_by_one(spark):
    rng = random.Random(5)
    rows = [(p, e, float(e == p % 7) + rng.random(), rng.choice([None, rng.random()]), int(e == p % 7))
            for p in range(6) for e in range(7)]
    df = spark.createDataFrame(rows, "season int, e int, a double, b double, y int")
    spec = ML.logreg_l2()
    ranks, summary = ST.rolling_eval(df, ["a", "b"], "y", "season", ["e"], spec)
    got = {r.season: (r["rank"], r.score) for r in ranks.collect()}
    assert set(got) == set(range(1, 6)) and summary.count() == 1
    for s in got:
        fm = ML.fit_model(df.where(f"season < {s}"), ["a", "b"], "y", spec)
        scored = sorted(((r.score, -r.e, r.y) for r in fm.score(df.where(f"season = {s}")).collect()), reverse=True)
        at = next(i for i, r in enumerate(scored) if r[2] == 1)
        assert got[s] == (at + 1, pytest.approx(scored[at][0], abs=1e-6))
    curve = ST.learning_curve(df.where("season < 5"), ["a", "b"], "y", "season", df.where("season = 5"), spec).collect()
    assert [r.status for r in sorted(curve, key=lambda r: r.frac)] == ["too_few_periods"] * 2 + ["ok"] * 3
    for r in curve:
        if r.status == "ok":
            fm = ML.fit_model(df.where(f"season < {r.n_periods}"), ["a", "b"], "y", spec)
            assert r.val_auc_mean == pytest.approx(ST._auc_value(fm.score(df.where("season = 5")), "score", "y"))


def test_split_quality_of_a_perfect_and_an_absent_winner(spark):
    rows = [("mvp", "m", s, p, e, int(e == 2 and s == "val"), e / 4) for s in ("val", "test") for p in (1, 2) for e in range(3)]
    df = spark.createDataFrame(rows, "award string, model string, split string, season int, e int, y int, score double")
    got = {r.split: r for r in ST.split_quality(df, "season", "score", "y", ["e"]).collect()}
    assert (got["val"].average_precision, got["val"].top1, got["val"].mrr, got["val"].n_winners) == (1.0, 1.0, 1.0, 2)
    assert got["test"].average_precision is None and got["test"].top1 is None
