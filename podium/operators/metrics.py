"""Ranking and classification metrics (M1-M9).

All metrics return small DataFrames (one row per report group); nothing is
collected.  None of them orders a whole period or the whole table in one task:

* winner ranks (M1) count, per period, the rows that sort before the best
  positive -- a join with a one-row-per-period table and a partial count;
* AUC (M3) and average precision (M4) fold equal scores first and take
  running totals over the distinct scores (:mod:`.ordering`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip_probability, col_ref
from .ordering import _as_list, all_of, exact_quantiles, join_summary, value_positions, written
from .windows import rank_in_period


def _label01(label_col: str):
    """1 for a positive (label == 1 after numeric coercion), else 0."""
    return F.coalesce((col_ref(label_col).try_cast("double") == F.lit(1.0)).cast("int"), F.lit(0))


def winner_ranks(df: DataFrame, period_col: str | Sequence[str], score_col: str, label_col: str,
                 tiebreak: Sequence[str]) -> DataFrame:
    """Per period, the rank of the best-ranked positive (1 = first) under the
    ordering score desc, tiebreak asc.  Periods without a positive (or whose
    positives have no score) are absent.  Computed as 1 + the number of scored
    rows that sort before that positive."""
    groups, tiebreak = _as_list(period_col), list(tiebreak)
    # sorts before: a larger score, or the same and a smaller tiebreak
    scored = df.where(col_ref(score_col).isNotNull()).select(
        *[col_ref(g).alias(f"g{i}") for i, g in enumerate(groups)], _label01(label_col).alias("y"),
        col_ref(score_col).alias("s"), F.struct(F.lit(0).alias("z"), *[col_ref(t).alias(f"t{i}") for i, t in enumerate(tiebreak)]).alias("t"))
    keys = [f"g{i}" for i in range(len(groups))]
    # the smallest tiebreak of each score, then the largest score: two partial aggregations
    best = (scored.where("y = 1").groupBy(*keys, "s").agg(F.min("t").alias("bt"))
            .groupBy(*[F.col(k).alias(f"b{k}") for k in keys])
            .agg(F.max(F.struct(F.col("s").alias("bs"), "bt")).alias("best"))
            .select(*[f"b{k}" for k in keys], "best.bs", "best.bt"))
    j = join_summary(scored, best, [(k, f"b{k}") for k in keys], "inner")
    ahead = (F.col("s") > F.col("bs")) | ((F.col("s") == F.col("bs")) & (F.col("t") < F.col("bt")))
    return j.groupBy(*[F.col(k).alias(g) for k, g in zip(keys, groups)]).agg(
        (F.sum(ahead.cast("long")) + F.lit(1)).alias("winner_rank"))


def summarize_ranks(ranks: DataFrame, rank_col: str = "winner_rank", group_cols: Sequence[str] = (),
                    ks: Sequence[int] = (1, 5), count_name: str = "n_periods") -> DataFrame:
    """hit@k, MRR, mean rank and count over a table of ranks.  With no rank:
    hit@k = 0, MRR = 0, mean rank NULL, count 0."""
    group_cols = list(group_cols)
    r = F.col(rank_col).cast("double")
    aggs = [F.coalesce(F.avg((r <= k).cast("double")), F.lit(0.0)).alias(f"hit_at_{k}") for k in ks]
    aggs += [F.coalesce(F.avg(F.lit(1.0) / r), F.lit(0.0)).alias("mrr"),
             F.avg(r).alias("mean_winner_rank"),
             F.count(F.col(rank_col)).alias(count_name)]
    if group_cols:
        return ranks.groupBy(*group_cols).agg(*aggs)
    return ranks.agg(*aggs)


def ranking_report(df: DataFrame, period_col: str, score_col: str, label_col: str,
                   tiebreak: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """M1: per period the best rank of a positive; periods without a positive
    are ignored; -> hit@1, hit@5, MRR, mean winner rank, number of periods (one
    row per report group, e.g. model and split)."""
    group_cols = list(group_cols)
    wr = winner_ranks(df, [*group_cols, period_col], score_col, label_col, tiebreak)
    return summarize_ranks(wr, "winner_rank", group_cols)


def winner_rank_table(df: DataFrame, period_col: str, score_col: str, label_col: str,
                      tiebreak: Sequence[str], keep: Sequence[str] = (), rank_col: str = "rank") -> DataFrame:
    """M6: one row per positive row with its rank in the period (several
    positives in a period each get a row)."""
    ranked = rank_in_period(df.select(period_col, score_col, label_col,
                                      *dict.fromkeys([*tiebreak, *keep])), period_col, score_col,
                            tiebreak, rank_col)
    cols = list(dict.fromkeys([period_col, *keep, score_col, rank_col]))
    return ranked.where(_label01(label_col) == 1).select(*cols)


def topk_accuracy(df: DataFrame, period_col: str, score_col: str, label_col: str,
                  tiebreak: Sequence[str], ks: Sequence[int] = (1, 3, 5, 10),
                  group_cols: Sequence[str] = (), empty_as_zero: bool = True) -> DataFrame:
    """M2: top-k accuracy and MRR per positive *row* (several positives in a
    period count separately).  Empty input gives 0.0 (``empty_as_zero``) or
    NULL."""
    group_cols = list(group_cols)
    keep = list(dict.fromkeys([*group_cols, *tiebreak]))
    ranked = rank_in_period(df.select(period_col, score_col, label_col, *keep),
                            [*group_cols, period_col], score_col, tiebreak, "__rk")
    pos = ranked.where(_label01(label_col) == 1)
    r = F.col("__rk").cast("double")
    fill = (lambda e: F.coalesce(e, F.lit(0.0))) if empty_as_zero else (lambda e: e)
    aggs = [fill(F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0)))).alias(f"top{k}") for k in ks]
    aggs += [fill(F.avg(F.coalesce(F.lit(1.0) / r, F.lit(0.0)))).alias("mrr"),
             F.count(F.lit(1)).alias("n_winners")]
    return pos.groupBy(*group_cols).agg(*aggs) if group_cols else pos.agg(*aggs)


def roc_auc(df: DataFrame, score_col: str, label_col: str, group_cols: Sequence[str] = (),
            out_col: str = "auc", *, blocks: int | None = None) -> DataFrame:
    """M3: exact ROC AUC with ties (Mann-Whitney with average ranks); NULL when
    a group has a single class.  Rows with a NULL score are left out."""
    group_cols = list(group_cols)
    y = _label01(label_col)
    vp = value_positions(df.select(*group_cols, F.col(score_col).cast("double").alias("__s"), y.alias("__y")),
                         group_cols, "__s", {"__pos": F.col("__y"), "__neg": F.lit(1) - F.col("__y")},
                         blocks=blocks)
    aggs = [F.sum(F.col("__pos") * F.col("_avg_rank")).alias("__rsum"),
            F.sum("__pos").cast("double").alias("__P"), F.sum("__neg").cast("double").alias("__N")]
    a = vp.groupBy(*group_cols).agg(*aggs) if group_cols else vp.agg(*aggs)
    auc = F.when((F.col("__P") > 0) & (F.col("__N") > 0),
                 (F.col("__rsum") - F.col("__P") * (F.col("__P") + 1.0) / 2.0) / (F.col("__P") * F.col("__N")))
    return a.select(*group_cols, auc.alias(out_col))


def average_precision(df: DataFrame, score_col: str, label_col: str, group_cols: Sequence[str] = (),
                      out_col: str = "average_precision", *, blocks: int | None = None) -> DataFrame:
    """M4: sum over distinct thresholds (high to low) of (recall step) x
    precision = sum(tp_i * cum_tp_i / cum_n_i) / P.  NULL without positives."""
    group_cols = list(group_cols)
    y = _label01(label_col)
    vp = value_positions(df.select(*group_cols, F.col(score_col).cast("double").alias("__s"), y.alias("__y")),
                         group_cols, "__s", {"__tp": F.col("__y")}, descending=True, blocks=blocks)
    aggs = [F.sum(F.col("__tp") * F.col("cum___tp") / F.col("cum__n")).alias("__num"),
            F.sum("__tp").cast("double").alias("__P")]
    a = vp.groupBy(*group_cols).agg(*aggs) if group_cols else vp.agg(*aggs)
    return a.select(*group_cols, F.when(F.col("__P") > 0, F.col("__num") / F.col("__P")).alias(out_col))


def log_loss(df: DataFrame, prob_col: str, label_col: str, group_cols: Sequence[str] = (),
             out_col: str = "log_loss", eps: float = 1e-6) -> DataFrame:
    """M5: mean binary cross-entropy after clipping probabilities."""
    group_cols = list(group_cols)
    p = clip_probability(prob_col, eps)
    y = _label01(label_col).cast("double")
    e = F.avg(-(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))).alias(out_col)
    src = df.where(F.col(prob_col).isNotNull())
    return src.groupBy(*group_cols).agg(e) if group_cols else src.agg(e)


def winner_rank_summary(ranks: DataFrame, rank_col: str = "rank", group_cols: Sequence[str] = (),
                        ks: Sequence[int] = (1, 3, 5, 10), period_col: str | None = None) -> DataFrame:
    """M7: distinct periods (without ``period_col``: winner rows), top-k rates, MRR,
    exact median and worst winner rank over a table with one row per winner."""
    group_cols = list(group_cols)
    r = col_ref(rank_col).cast("double")
    seasons = F.count(col_ref(rank_col)) if period_col is None else F.count_distinct(col_ref(period_col))
    aggs = [seasons.alias("seasons")]
    aggs += [F.avg((r <= k).cast("double")).alias(f"top{k}") for k in ks]
    aggs += [F.avg(F.lit(1.0) / r).alias("mrr"), F.max(r).alias("max_rank")]
    src = ranks.where(col_ref(rank_col).isNotNull())
    median = exact_quantiles(src, group_cols, rank_col, [0.5], ["median_rank"]).drop("n")
    order = [*group_cols, "seasons", *[f"top{k}" for k in ks], "mrr", "median_rank", "max_rank"]
    if not group_cols:
        return src.agg(*aggs).select("*", median.select("median_rank").scalar().alias("median_rank")).select(*order)
    both = src.groupBy(*group_cols).agg(*aggs)
    m = median.select(*[col_ref(g).alias(f"__{g}") for g in group_cols], "median_rank")
    cond = [col_ref(g).eqNullSafe(col_ref(f"__{g}")) for g in group_cols]
    return both.join(m, all_of(cond), "left").select(*order)


def metrics_by_award(scored: DataFrame, period_col: str, score_col: str, label_col: str,
                     tiebreak: Sequence[str], group_cols: Sequence[str] = ("award", "model"),
                     split_col: str = "split") -> DataFrame:
    """M8: one row per (award, model): val/test AUC, hit@1/5, MRR, test mean
    winner rank, number of test periods.  ``scored`` holds the scored rows of
    every model (a ``model`` column), so one plan serves all models."""
    group_cols = list(group_cols)
    # scoring may be costly and two metrics read it: written once, with the columns they need
    s = written(scored.where(F.col(split_col).isin("val", "test")).select(*[col_ref(c) for c in dict.fromkeys(
        [*group_cols, split_col, period_col, score_col, label_col, *tiebreak])]), "scored")
    auc = roc_auc(s, score_col, label_col, [*group_cols, split_col])
    rep = ranking_report(s, period_col, score_col, label_col, tiebreak, [*group_cols, split_col])
    both = auc.join(rep, [*group_cols, split_col], "full")

    def pick(split, c):
        return F.max(F.when(F.col(split_col) == split, F.col(c)))

    return both.groupBy(*group_cols).agg(
        pick("val", "auc").alias("val_auc"), pick("test", "auc").alias("test_auc"),
        pick("val", "hit_at_1").alias("val_hit_at_1"), pick("val", "hit_at_5").alias("val_hit_at_5"),
        pick("val", "mrr").alias("val_mrr"),
        pick("test", "hit_at_1").alias("test_hit_at_1"), pick("test", "hit_at_5").alias("test_hit_at_5"),
        pick("test", "mrr").alias("test_mrr"),
        pick("test", "mean_winner_rank").alias("test_mean_winner_rank"),
        F.coalesce(pick("test", "n_periods"), F.lit(0)).alias("n_test_seasons"))


def generalization_gap(df: DataFrame, val_col: str = "val_auc", test_col: str = "test_auc",
                       out_col: str = "gap") -> DataFrame:
    """M9: ``test - val`` per row (NULL if either is NULL)."""
    return df.withColumn(out_col, F.col(test_col) - F.col(val_col))


def top1(df: DataFrame, period_col: str, score_col: str, label_col: str, tiebreak: Sequence[str],
         group_cols: Sequence[str] = ()) -> DataFrame:
    """M2: share of positive rows ranked first in their period."""
    return topk_accuracy(df, period_col, score_col, label_col, tiebreak, (1,), group_cols).select(
        *group_cols, "top1")


def mrr(df: DataFrame, period_col: str, score_col: str, label_col: str, tiebreak: Sequence[str],
        group_cols: Sequence[str] = ()) -> DataFrame:
    """M2: mean reciprocal rank over positive rows."""
    return topk_accuracy(df, period_col, score_col, label_col, tiebreak, (1,), group_cols).select(
        *group_cols, "mrr")
