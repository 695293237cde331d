"""Fitting loops and model studies (ML10, ML12, ML15-ML19).

Every fit is a set of Spark jobs over the full training rows.  The fits of a
study (models, C values, feature groups, fractions, folds) run side by side,
``podium.studies.width`` at a time, and share the medians and the scale of a
training part; parts that are prefixes of the periods get theirs in one pass.  Their scored rows form one table, whose AUCs or ranks are taken in
one grouped pass; a handful of numbers per fit reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.scalar import col_ref
from ..operators import aggregate as G
from ..operators import metrics as M
from ..operators import ordering as O
from ..operators import windows as W
from ..session import cut_lineage
from .models import ModelSpec, fit_model, fit_prepared, model_grid, prepare
from .prefix_stats import prepare_prefixes

# ---------------------------------------------------------------------------
# Fixed values (the reference's study grids)
# ---------------------------------------------------------------------------
FAMILY_ORDER = ["baseline", "tree"]
SWEEP_C = [0.01, 0.1, 1.0, 10.0]
SWEEP_SEEDS = 5
PERMUTATION_REPEATS = 2
PERMUTATION_MAX_ROWS = 3000
PERMUTATION_SEED = 42
# ---------------------------------------------------------------------------


#: session setting: fits that run at the same time
WIDTH_CONF = "podium.studies.width"
DEFAULT_WIDTH = 4


def side_by_side(spark: SparkSession, jobs: Sequence[Callable], width: int | None = None) -> list:
    """The results of the jobs, in their order, ``width`` at a time, each from a thread of
    its own with the caller's job settings.  The first failure is raised."""
    width = width or int(spark.conf.get(WIDTH_CONF, str(DEFAULT_WIDTH)))
    if width < 2 or len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(width) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs))


def _auc_value(df: DataFrame, score: str, label: str) -> float | None:
    r = M.roc_auc(df, score, label).first()
    return None if r is None else r["auc"]


def grouped_aucs(parts: Sequence[tuple], label_col: str) -> dict:
    """{key: AUC} of (key, scored rows): one pass over all parts."""
    if not parts:
        return {}
    both = reduce(DataFrame.unionByName, [
        df.select(F.lit(i).alias("part"), col_ref("score").alias("score"), col_ref(label_col).alias("label"))
        for i, (_, df) in enumerate(parts)])
    found = {r["part"]: r["auc"] for r in M.roc_auc(both, "score", "label", ["part"]).collect()}
    return {key: found.get(i) for i, (key, _) in enumerate(parts)}


def fit_on_split(table: DataFrame, features: Sequence[str], label_col: str, period_col: str,
                 tiebreak: Sequence[str], specs: Sequence[ModelSpec] | None = None, award: str = "award",
                 split_col: str = "split", keep: Sequence[str] = ()) -> DataFrame:
    """ML10: per model, fit on the ``train`` split and score ``val`` and
    ``test``; returns the scored rows of every model (columns award, model,
    family, split, period, tiebreak/keep columns, label, score), ready for
    :func:`metrics_by_award`.  The table is cut from its lineage once (a
    reliable checkpoint) because every model reads it again."""
    specs = list(specs) if specs is not None else model_grid()
    base = cut_lineage(table)
    train = base.where(F.col(split_col) == "train")
    evals = base.where(F.col(split_col).isin("val", "test"))
    ids = list(dict.fromkeys([period_col, split_col, *tiebreak, *keep, label_col]))
    ready = prepare(train, features, label_col)
    try:
        fitted = side_by_side(base.sparkSession, [lambda spec=spec: fit_prepared(ready, spec) for spec in specs])
    finally:
        ready.release()
    return reduce(DataFrame.unionByName, [
        fm.score(evals).select(F.lit(award).alias("award"), F.lit(spec.name).alias("model"),
                               F.lit(spec.family).alias("family"), *[col_ref(c) for c in ids], "score")
        for spec, fm in zip(specs, fitted)])


def split_quality(scored: DataFrame, period_col: str, score_col: str, label_col: str, tiebreak: Sequence[str],
                  keys: Sequence[str] = ("award", "model", "split")) -> DataFrame:
    """M2 (top-k accuracy and MRR of the positives) and M4 (average precision) of every
    award, model and split of :func:`fit_on_split`'s rows, which are written once;
    a split without a positive has null figures."""
    keys = list(keys)
    rows = O.written(scored, "scored")
    ap = M.average_precision(rows, score_col, label_col, keys)
    top = M.topk_accuracy(rows, period_col, score_col, label_col, tiebreak, group_cols=keys)
    return ap.join(top, keys, "left")


def select_family(scored: DataFrame, award_col: str = "award", family_col: str = "family",
                  score_col: str = "score", family_order: Sequence[str] = tuple(FAMILY_ORDER)) -> DataFrame:
    """ML12: per award, the family whose highest score (its top-1 score) is
    largest; ties go to the earlier family in ``family_order`` (baseline).
    Output: award, family, top1_score."""
    order = F.create_map(*[x for i, f in enumerate(family_order) for x in (F.lit(f), F.lit(i))])
    tops = scored.groupBy(award_col, family_col).agg(F.max(score_col).alias("top1_score"))
    tops = tops.withColumn("__ord", F.coalesce(order[F.col(family_col)], F.lit(len(family_order))))
    best = W.best_per_group(tops, [award_col], "top1_score", ["__ord", family_col])
    return best.select(award_col, family_col, "top1_score")


def chosen_rows(scored: DataFrame, choice: DataFrame, award_col: str = "award", family_col: str = "family") -> DataFrame:
    """The scored rows of the chosen family per award (a semi join on a table
    with one row per award)."""
    return scored.join(choice.select(award_col, family_col), [award_col, family_col], "left_semi")


def permuted_rows(df: DataFrame, features: Sequence[str], key: str, n_repeats: int, seed: int) -> DataFrame:
    """(part, n_part, row): for every feature and repeat (part = place of the feature x
    repeats + repeat) all rows of ``df`` as a struct, with that feature's values dealt
    to the rows anew.

    One ordered pass numbers the rows by ``key``, another numbers each part's values
    by a hash of the row's number; equal numbers meet in one join.  So the jobs do
    not grow with features and repeats, and each part is a permutation."""
    columns = df.columns
    numbered = df.select(F.struct(*[col_ref(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"), col_ref(key).alias("k"))
    numbered = O.written(O.row_positions(numbered, [], [("k", True)], "at"), "numbered")
    place = [columns.index(f) for f in features]
    types = {df.schema[f].dataType for f in features}
    kind = types.pop() if len(types) == 1 else "double"
    parts = [(i * n_repeats + r, c) for i, c in enumerate(place) for r in range(n_repeats)]
    values = numbered.select("at", F.explode(F.array(*[
        F.struct(F.lit(p).alias("part"), F.col(f"row.c{c}").cast(kind).alias("v")) for p, c in parts])).alias("x"))
    values = values.select("x.part", "x.v", "at", F.xxhash64(F.lit(seed), "x.part", "at").alias("h"))
    dealt = O.row_positions(values, ["part"], [("h", True), ("at", True)], "to").select(
        F.col("part").alias("d_part"), "to", "v")
    rows = numbered.select("row", "at", F.explode(F.array(*[F.lit(p) for p, _ in parts])).alias("part"))
    met = rows.join(dealt, (F.col("part") == F.col("d_part")) & (F.col("at") == F.col("to")))

    def field(i: int, c: str) -> Column:
        mine = [p for p, at in parts if at == i]
        old = F.col(f"row.c{i}")
        return (F.when(F.col("part").isin(mine), F.col("v").cast(df.schema[c].dataType)).otherwise(old) if mine else old).alias(f"c{i}")

    return met.select("part", F.struct(*[field(i, c) for i, c in enumerate(columns)]).alias("row"))


def permutation_importance(fm, df: DataFrame, label_col: str, key: str, n_repeats: int = PERMUTATION_REPEATS,
                           seed: int = PERMUTATION_SEED, max_rows: int | None = None,
                           top_n: int | None = None) -> DataFrame:
    """ML15: AUC drop when one feature is shuffled, mean and population std over
    ``n_repeats``, the ``top_n`` largest (default: all); all rows unless ``max_rows`` asks for a Bernoulli sample.
    All shuffles are one table, scored and ranked in one pass."""
    spark = df.sparkSession
    src = df
    if max_rows is not None:
        n = src.count()
        if n > max_rows:
            src = src.sample(False, max_rows / float(n), seed)
    src = cut_lineage(src)
    base = _auc_value(fm.score(src), "score", label_col)
    part = O.fresh("__part", src)
    shuffled = permuted_rows(src, fm.features, key, n_repeats, seed).select(
        F.col("part").alias(part), *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(src.columns)])
    aucs = M.roc_auc(fm.score(shuffled), "score", label_col, [part]).collect()  # one row per feature and repeat
    rows = [(fm.features[r[part] // n_repeats], float(base - r["auc"])) for r in aucs
            if base is not None and r["auc"] is not None]
    out = spark.createDataFrame(rows, "feature string, drop double")
    return (out.groupBy("feature").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
            .orderBy(F.col("importance_mean").desc(), "feature").limit(top_n or len(fm.features)))


def hparam_sweep(train: DataFrame, val: DataFrame, features: Sequence[str], label_col: str,
                 Cs: Sequence[float] = tuple(SWEEP_C), l1_ratio: float = 0.0, seeds: Sequence[int] = tuple(range(SWEEP_SEEDS)),
                 award: str = "award", feature_set: str = "baseline", min_pos: int = 1) -> DataFrame:
    """ML16 (raises on a single class or fewer than ``min_pos`` positives): logistic regression over a grid of C x seeds; train and val AUC
    per run, then mean and std per C (G16).  The solver takes no seed (D13), so each C
    is fitted once and its result stands for the runs of all ``seeds``."""
    spark = train.sparkSession
    train, val = cut_lineage(train), cut_lineage(val)
    G.check_class_balance(train, label_col, min_pos)
    ready = prepare(train, features, label_col)
    specs = [ModelSpec(f"logreg_C{c}", "linear", "logreg", {"C": c, "l1_ratio": l1_ratio, "max_iter": 1500}) for c in Cs]
    try:
        fitted = side_by_side(spark, [lambda spec=spec: fit_prepared(ready, spec) for spec in specs])
    finally:
        ready.release()
    aucs = grouped_aucs([((c, part), fm.score(rows)) for c, fm in zip(Cs, fitted)
                         for part, rows in (("train", train), ("val", val))], label_col)
    res = [(float(c), int(s), aucs[c, "train"], aucs[c, "val"]) for c in Cs for s in seeds]
    runs = spark.createDataFrame(res, "C double, seed int, train_auc double, val_auc double")
    agg = G.seed_mean_std(runs, ["C"], ["train_auc", "val_auc"])
    return agg.select(F.lit(award).alias("award"), F.lit(feature_set).alias("feature_set"),
                      F.lit("l1" if l1_ratio == 1 else "elasticnet" if l1_ratio > 0 else "l2").alias("penalty"),
                      F.lit(float(l1_ratio)).alias("l1_ratio"), "C", "n_runs",
                      "train_auc_mean", "train_auc_std", "val_auc_mean", "val_auc_std")


def feature_ablation(table: DataFrame, features: Sequence[str], label_col: str, spec: ModelSpec,
                     split_col: str = "split", seeds: Sequence[int] = (0,),
                     groups: dict[str, list[str]] | None = None, min_pos: int = 1) -> DataFrame:
    """ML17 (raises on a single class or fewer than ``min_pos`` positives): the full feature list, then one variant per non-empty group
    (F7) with that group's columns dropped; AUC per split, mean/std over
    seeds."""
    spark = table.sparkSession
    base = cut_lineage(table)
    parts = {s: base.where(F.col(split_col) == s) for s in ("train", "val", "test")}
    G.check_class_balance(parts["train"], label_col, min_pos)
    gm = N.feature_groups(features, groups)
    variants = [("baseline", [])] + [(f"no_{g}", cols) for g, cols in gm.items() if cols]
    tried = []
    for name, dropped in variants:
        feats = [f for f in features if f not in set(dropped)]
        tried += [(name, dropped, feats, int(s), ModelSpec(spec.name, spec.family, spec.kind, {**spec.params, "seed": s},
                                                          spec.scale, spec.weighted)) for s in seeds if feats]
    fitted = side_by_side(spark, [lambda t=t: fit_model(parts["train"], t[2], label_col, t[4]) for t in tried])
    aucs = grouped_aucs([((i, k), fm.score(parts[k])) for i, fm in enumerate(fitted) for k in parts], label_col)
    res = [(name, ",".join(dropped), s, *[aucs[i, k] for k in ("train", "val", "test")])
           for i, (name, dropped, _, s, _) in enumerate(tried)]
    runs = spark.createDataFrame(res, "variant string, dropped_cols string, seed int, train_auc double, "
                                      "val_auc double, test_auc double")
    return G.seed_mean_std(runs, ["variant", "dropped_cols"], ["train_auc", "val_auc", "test_auc"]).withColumn(
        "model", F.lit(spec.name))


def learning_curve(table: DataFrame, features: Sequence[str], label_col: str, period_col: str,
                   val: DataFrame, spec: ModelSpec, fracs: Sequence[float] = W.LEARNING_FRACTIONS,
                   seeds: Sequence[int] = (0,), min_pos: int = 1) -> DataFrame:
    """ML18: W10 fractions of the earliest periods; fits only where the fold
    status is ``ok``; failures stay as status rows."""
    spark = table.sparkSession
    base = cut_lineage(table)
    folds = W.learning_curve_folds(base, period_col, label_col, fracs, min_pos=min_pos).collect()  # one row per fraction
    tried = [(fr, s, ModelSpec(spec.name, spec.family, spec.kind, {**spec.params, "seed": s}, spec.scale, spec.weighted))
             for fr in folds if fr["status"] == "ok" for s in seeds]

    def part(fr) -> DataFrame:
        return base.where(F.col(period_col) <= fr["periods_max"])

    val = cut_lineage(val)
    ready = prepare_prefixes(base, features, label_col, period_col, {fr["periods_max"] for fr, _, _ in tried}, inclusive=True)
    try:
        fitted = side_by_side(spark, [lambda t=t: fit_prepared(ready.part(t[0]["periods_max"]), t[2]) for t in tried])
    finally:
        ready.release()
    aucs = grouped_aucs([((fr["frac"], s, k), fm.score(rows)) for (fr, s, _), fm in zip(tried, fitted)
                         for k, rows in (("train", part(fr)), ("val", val))], label_col)
    res = []
    for fr in folds:
        ok = fr["status"] == "ok"
        means = [_mean([aucs[fr["frac"], s, k] for s in seeds]) if ok else None for k in ("train", "val")]
        res.append((fr["frac"], fr["n_periods"], fr["n_train_rows"], fr["n_pos"], *means, len(seeds) if ok else 0, fr["status"]))
    return spark.createDataFrame(res, "frac double, n_periods long, n_train_rows long, n_pos long, "
                                      "train_auc_mean double, val_auc_mean double, n_runs int, status string")


def _mean(xs):
    xs = [x for x in xs if x is not None]
    return sum(xs) / len(xs) if xs else None


def rolling_eval(table: DataFrame, features: Sequence[str], label_col: str, period_col: str,
                 tiebreak: Sequence[str], spec: ModelSpec, first_period: int | None = None,
                 last_period: int | None = None) -> tuple[DataFrame, DataFrame]:
    """ML19: walk-forward (W9): for each test period s, fit on all periods
    < s and rank period s; returns the winner-rank table (M6) and its summary
    (M7)."""
    spark = table.sparkSession
    base = cut_lineage(table)
    folds = W.walk_forward_folds(base, period_col, label_col, first_period, last_period)
    tests = [r["fold"] for r in folds.where(F.col("role") == "test").select("fold").orderBy("fold").collect()]
    if not tests:
        ranks = spark.createDataFrame([], f"{period_col} long, score double, rank long")
        return ranks, M.winner_rank_summary(ranks, "rank", period_col=period_col)

    ready = prepare_prefixes(base, features, label_col, period_col, tests)
    try:
        fitted = side_by_side(spark, [lambda s=s: fit_prepared(ready.part(s), spec) for s in tests])
    finally:
        ready.release()
    # every fold ranks a period of its own: one pass over all
    every = reduce(DataFrame.unionByName, [fm.score(base.where(F.col(period_col) == s)) for s, fm in zip(tests, fitted)])
    ranks = O.written(M.winner_rank_table(every, period_col, "score", label_col, tiebreak), "ranks")
    return ranks, M.winner_rank_summary(ranks, "rank", period_col=period_col)
