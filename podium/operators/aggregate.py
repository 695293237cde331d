"""Aggregations.

Grouped statistics are partial aggregations; exact medians and quartiles
come from running counts (:mod:`.ordering`), never from collecting a group's
values into one buffer.  Several columns are handled in one pass by
unpivoting them into (feature, value) rows and grouping by feature.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col_ref
from .ordering import _as_list, exact_quantiles, join_summary
from .windows import best_per_group


def _long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), feature: str = "feature",
          value: str = "value") -> DataFrame:
    """Unpivot numeric columns into (keep..., feature, value) as doubles."""
    cast = df.select(*[col_ref(k) for k in keep], *[col_ref(c).cast("double").alias(c) for c in cols])
    return cast.unpivot([col_ref(k) for k in keep], [col_ref(c) for c in cols], feature, value)


def dedup_most_complete(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """G1: one row per key: the row with the most non-NULL values; ties go to
    the first row in ``order_col`` order."""
    keys = list(keys)
    nonnull = sum((col_ref(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    scored = df.withColumn("__nonnull", nonnull)
    best = best_per_group(scored, keys, "__nonnull", [order_col])
    return best.select(*[col_ref(c) for c in df.columns])


DESCRIBE_STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def describe_numeric(df: DataFrame, cols: Sequence[str], where=None) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles, max per column (one
    row per column).  ``where`` restricts to a subset of rows."""
    src = df.where(where) if where is not None else df
    long = _long(src, cols)
    basic = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(long, ["feature"], "value", [0.25, 0.5, 0.75], ["p25", "p50", "p75"]).drop("n")
    return (basic.join(q, "feature", "left")
            .select("feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max"))


def rows_per_period(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, ordered by value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(col)


def count_wins(df: DataFrame, entity_col: str, period_col: str, rank_col: str, top: int = 15) -> DataFrame:
    """Entities by the number of distinct periods in which they rank 1;
    the ``top`` first (ties by entity)."""
    r = col_ref(rank_col).try_cast("double")
    wins = (df.where(r == 1.0).select(entity_col, period_col).distinct()
            .groupBy(entity_col).agg(F.count(F.lit(1)).alias("n_wins")))
    return wins.orderBy(F.col("n_wins").desc(), F.col(entity_col)).limit(top)


def count_selections(df: DataFrame, entity_col: str, col: str, top: int = 15) -> DataFrame:
    """Entities by the number of rows where ``col`` is not NULL; top 15."""
    sel = (df.where(col_ref(col).isNotNull()).groupBy(entity_col)
           .agg(F.count(F.lit(1)).alias("n_selections")))
    return sel.orderBy(F.col("n_selections").desc(), F.col(entity_col)).limit(top)


def positives_per_period(df: DataFrame, period_col: str, label_col: str) -> DataFrame:
    """Sum of the label per period (label NULL = 0)."""
    return df.groupBy(period_col).agg(
        F.sum(F.coalesce(col_ref(label_col).try_cast("double"), F.lit(0.0))).alias("n_pos"))


def winners_per_period(df: DataFrame, period_col: str, label_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Over periods, min / median / max of the positives per period and
    the number of periods with none.  The per-period table has one row per
    period, so the median over it is small."""
    group_cols = list(group_cols)
    per = df.groupBy(*group_cols, period_col).agg(
        F.sum(F.coalesce(col_ref(label_col).try_cast("double"), F.lit(0.0))).alias("n_pos"))
    aggs = [F.min("n_pos").alias("min_pos"), F.median("n_pos").alias("median_pos"),
            F.max("n_pos").alias("max_pos"), F.count(F.lit(1)).alias("n_periods"),
            F.sum((F.col("n_pos") == 0).cast("long")).alias("n_zero")]
    return per.groupBy(*group_cols).agg(*aggs) if group_cols else per.agg(*aggs)


def periods_without_positive(df: DataFrame, period_col: str, label_col: str) -> DataFrame:
    """G6 (list part): the periods whose label sum is 0, sorted."""
    return (positives_per_period(df, period_col, label_col).where(F.col("n_pos") == 0)
            .select(period_col).orderBy(period_col))


def label_distribution(df: DataFrame, split_col: str, label_col: str, period_col: str) -> DataFrame:
    """Per split and class: count and share (6 dp) of the split, plus the
    split's period span, positive rate and winners-per-period summary."""
    y = F.coalesce(col_ref(label_col).try_cast("double"), F.lit(0.0)).cast("int")
    cls = df.groupBy(split_col, y.alias("y")).agg(F.count(F.lit(1)).alias("n"))
    tot = cls.groupBy(split_col).agg(F.sum("n").alias("__tot"))
    span = df.groupBy(split_col).agg(F.min(period_col).alias("period_min"), F.max(period_col).alias("period_max"),
                                     F.avg(y.cast("double")).alias("positive_rate"))
    wpp = winners_per_period(df, period_col, label_col, [split_col])
    return (cls.join(tot, split_col).withColumn("ratio", F.round(F.col("n") / F.col("__tot"), 6)).drop("__tot")
            .join(span, split_col).join(wpp, split_col))


def describe_split(df: DataFrame, split_col: str, period_col: str, label_col: str) -> DataFrame:
    """Per split: rows, distinct periods, period span, positives."""
    y = F.coalesce(col_ref(label_col).try_cast("double"), F.lit(0.0))
    return df.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(period_col).alias("n_periods"),
        F.min(period_col).alias("period_min"), F.max(period_col).alias("period_max"),
        F.sum(y).cast("long").alias("n_pos"))


def period_coverage(df: DataFrame, period_col: str, last: int = 5) -> DataFrame:
    """Min, max, number of distinct periods and the last ``last``
    periods (one row).  Built on the distinct-period table."""
    periods = df.select(period_col).where(F.col(period_col).isNotNull()).distinct()
    lastk = periods.orderBy(F.col(period_col).desc()).limit(last)
    summary = periods.agg(F.min(period_col).alias("period_min"), F.max(period_col).alias("period_max"),
                          F.count(F.lit(1)).alias("n_periods"))
    tail = lastk.agg(F.sort_array(F.collect_list(period_col))).scalar()  # at most `last` values
    return summary.withColumn("last_periods", tail)


def correlation_matrix(df: DataFrame, cols: Sequence[str], complete: bool = True) -> DataFrame:
    """Pearson correlation of every pair (lower triangle, a < b in the
    given order), over complete cases or (``complete=False``) over the rows where
    both are present.  Two vector aggregations whatever the number of columns: the
    means, then one Gram matrix of the centred columns, of which the driver holds
    a square of the columns' number.  NULL (T3) where fewer than two rows remain, a
    value is infinite, or a column is constant: a deviation under 1e-13 of its mean,
    or 1e-7 of the distance of its rows from the mean of all."""
    cols = list(cols)
    schema = "col_a string, col_b string, corr double"
    spark = df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    src = df.select(*[col_ref(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    src = src.na.drop(how="any") if complete else src
    n, zero, one = len(cols), F.lit(0.0), F.lit(1.0)
    xs = [F.col(f"x{i}") for i in range(n)]
    there = [F.when(x.isNull(), zero).otherwise(one) for x in xs]
    vector = array_to_vector(F.array(*[F.coalesce(x, zero) for x in xs], *there))
    # grouped, as no row has no mean
    found = (src.select(vector.alias("v"), F.lit(True).alias("all")).groupBy("all")
             .agg(Summarizer.mean(F.col("v")).alias("m")).first())
    if found is None:
        return spark.createDataFrame([(a, b, None) for i, a in enumerate(cols) for b in cols[:i]], schema)
    sums, share = found.m.toArray()[:n], found.m.toArray()[n:]
    mean = np.divide(sums, share, out=np.zeros(n), where=share > 0)
    z = [F.coalesce(x - F.lit(float(m)), zero) for x, m in zip(xs, mean)]
    parts = [*z, one] if complete else [*z, *[v * v for v in z], *there]
    rows = MLUtils.convertVectorColumnsFromML(src.select(array_to_vector(F.array(*parts)).alias("v")), "v")
    gram = RowMatrix(rows, 0, len(parts)).computeGramianMatrix().toArray()
    # of the rows that both columns of a pair have: their number, sums and sums of squares
    xy = gram[:n, :n]
    if complete:
        rows_of, total = np.full((n, n), gram[n, n]), np.repeat(gram[:n, n:], n, axis=1)
        square = np.repeat(np.diag(xy)[:, None], n, axis=1)
    else:
        rows_of, total, square = gram[2 * n:, 2 * n:], gram[:n, 2 * n:], gram[n:2 * n, 2 * n:]
    with np.errstate(all="ignore"):
        var = square - total * total / rows_of
        flat = ~(var > np.maximum(1e-26 * rows_of * (mean * mean)[:, None], 1e-14 * square))
        corr = (xy - total * total.T / rows_of) / np.sqrt(var * var.T)
    corr[flat | flat.T | (rows_of < 2) | ~np.isfinite(corr)] = np.nan
    return spark.createDataFrame([(a, b, None if np.isnan(corr[i, j]) else float(corr[i, j]))
                                  for i, a in enumerate(cols) for j, b in enumerate(cols[:i])], schema)


def linear_trend(df: DataFrame, x: str, y: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope and intercept of y on x."""
    group_cols = list(group_cols)
    xv, yv = col_ref(x).cast("double"), col_ref(y).cast("double")
    both = xv.isNotNull() & yv.isNotNull()
    # intercept as mean(y) - slope * mean(x) over complete pairs: the same
    # least-squares value, better conditioned when x is far from 0 (years)
    aggs = [F.regr_slope(yv, xv).alias("slope"),
            F.avg(F.when(both, yv)).alias("__my"), F.avg(F.when(both, xv)).alias("__mx"),
            F.regr_count(yv, xv).alias("n")]
    a = df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)
    return a.select(*group_cols, "slope", (F.col("__my") - F.col("slope") * F.col("__mx")).alias("intercept"), "n")


def box_summary(df: DataFrame, group_col: str, value_col: str, whisker: float = 1.5) -> DataFrame:
    """Per group: exact quartiles, IQR, fences at ``whisker`` x IQR, the
    whisker ends (most extreme values inside the fences) and the number of
    outliers -- the data behind a box plot."""
    v = df.select(col_ref(group_col).alias(group_col), col_ref(value_col).cast("double").alias("__v"))
    q = exact_quantiles(v, [group_col], "__v", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    q = (q.withColumn("iqr", F.col("q3") - F.col("q1"))
         .withColumn("lo_fence", F.col("q1") - whisker * F.col("iqr"))
         .withColumn("hi_fence", F.col("q3") + whisker * F.col("iqr")))
    fences = q.select(col_ref(group_col).alias("__g"), "lo_fence", "hi_fence")
    j = join_summary(v, fences, [(group_col, "__g")], "inner").where(col_ref(group_col).isNotNull())
    ends = j.groupBy(group_col).agg(
        F.min(F.when(F.col("__v") >= F.col("lo_fence"), F.col("__v"))).alias("whisker_lo"),
        F.max(F.when(F.col("__v") <= F.col("hi_fence"), F.col("__v"))).alias("whisker_hi"),
        F.sum(((F.col("__v") < F.col("lo_fence")) | (F.col("__v") > F.col("hi_fence"))).cast("long"))
        .alias("n_outliers"))
    return q.join(ends, group_col, "left")


def winner_loser_profile(df: DataFrame, label_col: str, cols: Sequence[str], top: int = 30,
                         sample_non_winners: int | None = None, seed: int = 42) -> DataFrame:
    """Per feature: mean and exact median for positives and for the rest,
    and the difference of means; the ``top`` features by absolute difference.
    All rows by default; ``sample_non_winners`` keeps about that many negatives
    (Bernoulli sample, as an opt-in speed knob)."""
    y = F.coalesce(col_ref(label_col).try_cast("double"), F.lit(0.0)).cast("int")
    src = df.withColumn("__y", y)
    if sample_non_winners is not None:
        n_neg = src.where(F.col("__y") == 0).count()
        frac = min(1.0, sample_non_winners / n_neg) if n_neg else 1.0
        src = src.where(F.col("__y") == 1).unionByName(src.where(F.col("__y") == 0).sample(False, frac, seed))
    long = _long(src, cols, ["__y"])
    means = long.groupBy("feature", "__y").agg(F.avg("value").alias("mean"))
    meds = exact_quantiles(long, ["feature", "__y"], "value", [0.5], ["median"]).drop("n")
    both = means.join(meds, ["feature", "__y"], "left")
    wide = both.groupBy("feature").agg(
        F.max(F.when(F.col("__y") == 1, F.col("mean"))).alias("mean_winner"),
        F.max(F.when(F.col("__y") == 0, F.col("mean"))).alias("mean_other"),
        F.max(F.when(F.col("__y") == 1, F.col("median"))).alias("median_winner"),
        F.max(F.when(F.col("__y") == 0, F.col("median"))).alias("median_other"))
    wide = wide.withColumn("diff", F.col("mean_winner") - F.col("mean_other"))
    return wide.orderBy(F.abs("diff").desc_nulls_last(), "feature").limit(top)


def class_balance(df: DataFrame, label_col: str) -> DataFrame:
    """Positives and negatives (one row)."""
    y = F.coalesce(col_ref(label_col).try_cast("double"), F.lit(0.0))
    return df.agg(F.sum((y > 0).cast("long")).alias("n_pos"), F.sum((y <= 0).cast("long")).alias("n_neg"))


def check_class_balance(df: DataFrame, label_col: str, min_pos: int = 1) -> tuple[int, int]:
    """G15 guard: raise when a single class is present or positives are fewer
    than ``min_pos``."""
    r = class_balance(df, label_col).first()
    n_pos, n_neg = int(r["n_pos"] or 0), int(r["n_neg"] or 0)
    if n_pos == 0 or n_neg == 0:
        raise ValueError(f"single class: {n_pos} positives, {n_neg} negatives")
    if n_pos < min_pos:
        raise ValueError(f"too few positives: {n_pos} < {min_pos}")
    return n_pos, n_neg


def seed_mean_std(df: DataFrame, group_cols: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """Mean and sample std over repeated runs; std is 0 for one run."""
    aggs = []
    for c in _as_list(value_cols):
        aggs += [F.avg(col_ref(c)).alias(f"{c}_mean"),
                 F.coalesce(F.stddev_samp(col_ref(c)), F.lit(0.0)).alias(f"{c}_std")]
    aggs.append(F.count(F.lit(1)).alias("n_runs"))
    return df.groupBy(*group_cols).agg(*aggs)


def missing_rate(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL share per column, sorted descending (one aggregation)."""
    from .eligibility import missing_rates
    return missing_rates(df, cols)
