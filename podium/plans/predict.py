"""Period prediction (ML13): matrix -> align -> score -> rank -> choose the
family per award -> all rows + top-k + audit.  One batch job per award and
family over the target period; no per-row Python."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import shaping as P
from ..operators import windows as W
from ..operators.joins import union_by_name
from .datasets import ROW_ID, build_target_matrix
from .models import FittedModel
from .studies import chosen_rows, select_family


def score_period(hist: DataFrame | None, target: DataFrame, period: int,
                 models: Mapping[str, Mapping[str, FittedModel]], *, entity_col: str = "Player",
                 period_col: str = "season", team_col: str = "Tm", rookies: DataFrame | None = None,
                 feature_sets: Mapping[str, str] | None = None, eligibility: Mapping[str, dict] | None = None,
                 categories: Mapping[str, dict] | None = None) -> DataFrame:
    """The target period scored for every award with every candidate family and
    ranked inside the award and family (W3, ties by row id).  Awards whose matrix
    is empty simply contribute no rows."""
    parts = []
    for award, fams in models.items():
        for family, fm in fams.items():
            fs = (feature_sets or {}).get(family, "tree" if family == "tree" else "baseline")
            mat, spec = build_target_matrix(hist, target, period, award, entity_col=entity_col, period_col=period_col,
                                            team_col=team_col, rookies=rookies, feature_set=fs,
                                            categories=(categories or {}).get(award),
                                            eligibility=(eligibility or {}).get(award))
            x = P.align_features(mat, fm.features, keep=spec.id_cols)
            parts.append(fm.score(x).select(*spec.id_cols, F.lit(award).alias("award"),
                                            F.lit(family).alias("family"), "score"))
    if not parts:
        raise RuntimeError("no predictions produced (no models given)")
    return W.rank_in_period(union_by_name(*parts), ["award", "family"], "score", [ROW_ID])


def predict_period(hist: DataFrame | None, target: DataFrame, period: int,
                   models: Mapping[str, Mapping[str, FittedModel]], **options) -> tuple[DataFrame, DataFrame]:
    """``score_period`` with the chosen family of each award (ML12).  Returns (all rows
    of the chosen families, choice table).  Raises when no award produced a row."""
    ranked = score_period(hist, target, period, models, **options)
    choice = select_family(ranked)
    out = chosen_rows(ranked, choice)
    if out.isEmpty():
        raise RuntimeError("no predictions produced (all awards skipped)")
    return out, choice


predict_season = predict_period  # ML13 under the survey's name
