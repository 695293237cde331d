"""Sorts, limits and reshaping of result tables (K2-K4, R-1, R-2).  K1 lives
in :mod:`.windows` (``top_k_per_period``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import col_ref

# ---------------------------------------------------------------------------
# Sort keys of the model table, in priority order
# ---------------------------------------------------------------------------
METRICS_SORT_KEYS = ["val_mrr", "test_mrr", "val_top1", "test_top1", "val_aucpr", "test_aucpr"]
# ---------------------------------------------------------------------------


def top_k_global(df: DataFrame, metric: str, k: int, tiebreak: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    """K2: the ``k`` rows with the largest (or smallest) ``metric``; Spark
    plans a TakeOrderedAndProject (per-partition top-k, then a merge)."""
    m = col_ref(metric)
    order = [m.asc_nulls_last() if ascending else m.desc_nulls_last(), *[col_ref(t) for t in tiebreak]]
    return df.orderBy(*order).limit(k)


def metrics_table(df: DataFrame, keys: Sequence[str] = tuple(METRICS_SORT_KEYS), tiebreak: Sequence[str] = ()) -> DataFrame:
    """K3: descending sort, NULL last, on those of the sort keys that exist."""
    present = [k for k in keys if k in df.columns]
    return df.orderBy(*[col_ref(k).desc_nulls_last() for k in present], *[col_ref(t) for t in tiebreak])


def worst_periods(ranks: DataFrame, period_col: str, rank_col: str) -> DataFrame:
    """K4: winner ranks from worst to best (ties by period)."""
    return ranks.orderBy(col_ref(rank_col).desc_nulls_last(), col_ref(period_col))


def worst_period(ranks: DataFrame, period_col: str, rank_col: str) -> DataFrame:
    """K4: the single worst period and its rank (earliest period on ties)."""
    known = ranks.where(col_ref(rank_col).isNotNull())
    best = known.groupBy(col_ref(rank_col).alias("r")).agg(F.min(col_ref(period_col)).alias("p"))
    return best.agg(F.max_by(F.struct("p", "r"), "r").alias("w")).select(
        F.col("w.p").alias(period_col), F.col("w.r").alias(rank_col))


def melt_metrics(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str],
                 name_col: str = "metric", value_col: str = "value") -> DataFrame:
    """R-1: wide metrics -> (ids, metric, value); NULL values dropped."""
    cast = df.select(*[col_ref(c) for c in id_cols], *[col_ref(c).cast("double").alias(c) for c in value_cols])
    long = cast.unpivot([col_ref(c) for c in id_cols], [col_ref(c) for c in value_cols], name_col, value_col)
    return long.where(F.col(value_col).isNotNull())


def full_data_points(df: DataFrame, group_cols: Sequence[str] = ("source", "model"), frac_col: str = "frac",
                     status_col: str = "status", sort_col: str = "val_auc_mean") -> DataFrame:
    """R-2: per group keep the rows at the largest fraction, **then** keep
    status ``ok``; sorted by ``sort_col`` descending.  Learning-curve tables
    have a handful of rows per group, so a group window is bounded."""
    w = Window.partitionBy(*group_cols)
    top = df.withColumn("__mx", F.max(frac_col).over(w)).where(F.col(frac_col) == F.col("__mx")).drop("__mx")
    return top.where(F.col(status_col) == "ok").orderBy(col_ref(sort_col).desc_nulls_last(), *group_cols)
