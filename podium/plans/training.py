"""Training every award with every model, explaining a model, and scoring a
period from the models of the newest saved run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import windows as W
from ..session import cut_lineage
from ..sources import readers as R
from ..sources import writers as WR
from . import models as ML
from . import studies as ST
from .datasets import build_training_table
from .predict import score_period

SPLITS = ("train", "val", "test")
TOP_FEATURES = 25


def train_awards(facts: DataFrame, awards: Mapping[str, str], specs: Sequence[ML.ModelSpec] | None = None, *,
                 entity_col: str = "Player", period_col: str = "season", val_periods: int = 3, test_periods: int = 3,
                 min_pos: int = 1, feature_set: str = "baseline", eligibility: Mapping[str, dict] | None = None,
                 ) -> tuple[DataFrame, dict[tuple[str, str], ML.FittedModel]]:
    """One row per (award, model): status, rows and positives of each split, AUC
    and log loss on val and test, hit@1 and MRR on test; and the fitted models.

    ``awards`` maps an award to its label column.  An award whose training part
    has a single class or fewer than ``min_pos`` positives gets status rows
    instead of a fit.  Each award's table is built and checkpointed once.
    """
    spark, out, fitted = facts.sparkSession, None, {}
    specs = list(specs) if specs is not None else ML.model_grid()
    for award, label in awards.items():
        table, matrix = build_training_table(facts, award, label, entity_col=entity_col, period_col=period_col,
                                             feature_set=feature_set, eligibility=(eligibility or {}).get(award))
        table = cut_lineage(W.temporal_split_last_k(table, period_col, val_periods, test_periods))
        sizes = {r["split"]: r for r in table.groupBy("split").agg(
            F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).collect()}  # one row per split
        counts = [int(sizes[s][k] or 0) if s in sizes else 0 for s in SPLITS for k in ("n", "pos")]
        n_train, pos_train = counts[0], counts[1]
        status = ("empty_split" if not all(counts[::2]) else "single_class" if pos_train in (0, n_train)
                  else "too_few_positives" if pos_train < min_pos else "ok")
        for spec in specs:
            head = spark.createDataFrame(
                [(award, spec.name, spec.family, status, *counts)],
                "award string, model string, family string, status string, "
                + ", ".join(f"n_{s} long, pos_{s} long" for s in SPLITS))
            if status != "ok":
                row = head
            else:
                fm = ML.fit_model(table.where("split = 'train'"), matrix.features, "label", spec)
                fitted[award, spec.name] = fm
                scored = cut_lineage(fm.score(table.where("split <> 'train'")).select(
                    "split", period_col, entity_col, "label", "score"))
                row = head.select("*", *[c.alias(n) for n, c in _quality(scored, period_col, entity_col).items()])
            out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out, fitted


def _quality(scored: DataFrame, period_col: str, entity_col: str) -> dict:
    """Scalar subqueries of one model's quality, from its scored rows."""
    found = {}
    for split in ("val", "test"):
        part = scored.where(F.col("split") == split)
        found[f"{split}_auc"] = M.roc_auc(part, "score", "label").scalar()
        found[f"{split}_logloss"] = M.log_loss(part, "score", "label").scalar()
        report = M.ranking_report(part, period_col, "score", "label", [entity_col])
        found[f"{split}_hit_at_1"] = report.select("hit_at_1").scalar()
        found[f"{split}_mrr"] = report.select("mrr").scalar()
    return found


def explain(fm: ML.FittedModel, val: DataFrame, label_col: str, key: str, top_n: int = TOP_FEATURES) -> DataFrame:
    """(feature, value, std): the coefficients of a linear model, else the permutation
    importance on the validation rows; the ``top_n`` largest."""
    if hasattr(fm.models[0].stages[-1], "coefficients") and fm.spec.kind != "svm_calibrated":
        return ML.linear_coefficients(fm, top_n).select("feature", F.col("coef").alias("value"),
                                                        F.lit(None).cast("double").alias("std"))
    return ST.permutation_importance(fm, val, label_col, key, top_n=top_n).select(
        "feature", F.col("importance_mean").alias("value"), F.col("importance_std").alias("std"))


def save_run(fitted: Mapping[tuple[str, str], ML.FittedModel], root: str, run_id: str) -> None:
    """Models under ``award=.../run_id=.../model=...``."""
    for (award, name), fm in fitted.items():
        ML.save_model(fm, f"{root.rstrip('/')}/award={award}/run_id={run_id}/model={name}")


def load_newest(spark: SparkSession, root: str) -> dict[str, dict[str, ML.FittedModel]]:
    """Of each award the models of its newest run, by family."""
    found: dict[str, dict[str, ML.FittedModel]] = {}
    for award, folder in R.newest_runs(spark, root, ["award"]).items():
        for path in R.partition_folders(spark, folder, ["model"]):
            fm = ML.load_model(path)
            found.setdefault(award[0], {})[fm.spec.family] = fm
    return found


def predict_from_newest(spark: SparkSession, root: str, hist: DataFrame | None, target: DataFrame, period: int,
                        out_path: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """ML13 with the newest saved models; with ``out_path`` the ranked rows, the
    choice and its audit are written there."""
    families = {a: {"tree" if f == "tree" else "baseline": m for f, m in ms.items()}
                for a, ms in load_newest(spark, root).items()}
    ranked = cut_lineage(score_period(hist, target, period, families, **options))
    choice = ST.select_family(ranked)
    rows = ST.chosen_rows(ranked, choice)
    if out_path:
        WR.write_predictions(rows, out_path)
        WR.prediction_audit(ranked, choice, None, period).write.mode("overwrite").parquet(f"{out_path}/audit")
    return rows, choice
