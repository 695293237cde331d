"""Window operators.

Windows partitioned by *entity* are bounded (an entity has one row per
period), so they use ordinary Spark windows.  Anything ordered inside a
*period* goes through :mod:`.ordering`, because one period can hold an
unbounded share of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import col_ref
from ..session import cut_lineage
from .ordering import _as_list, average_ranks, join_summary, row_positions, with_row_id

PREV = "prev_"
DELTA = "delta_"


def _numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def default_prev_cols(df: DataFrame, entity_col: str, period_col: str,
                      exclude: Sequence[str] = ("Tm", "__row_id", "row_id")) -> list[str]:
    skip = {entity_col, period_col, *exclude}
    return [c for c in _numeric_cols(df)
            if c not in skip and not c.startswith(PREV) and not c.startswith(DELTA)]


def entity_window(df: DataFrame, entity_col: str) -> "Window":
    """Partitions of one entity each; a row without an entity is a partition of its
    own (by its hash), so such rows never pile up in one task."""
    alone = F.when(col_ref(entity_col).isNull(), F.xxhash64(*[col_ref(c) for c in df.columns]))
    return Window.partitionBy(col_ref(entity_col), alone)


def add_prev_features(df: DataFrame, entity_col: str, period_col: str,
                      cols: Sequence[str] | None = None, tiebreak: Sequence[str] = (),
                      prefix: str = PREV) -> DataFrame:
    """``prev_c`` = value of ``c`` on the entity's previous *row* in period
    order (row-based lag 1, so a gap is skipped, see T8).  All columns share
    one window, in one projection over one scan.  Rows with a NULL entity get
    NULL (T4)."""
    cols = default_prev_cols(df, entity_col, period_col) if cols is None else list(cols)
    w = entity_window(df, entity_col).orderBy(
        col_ref(period_col).asc_nulls_first(), *[col_ref(t).asc_nulls_first() for t in tiebreak])
    known = col_ref(entity_col).isNotNull()
    return df.select(*[col_ref(c) for c in df.columns],
                     *[F.when(known, F.lag(col_ref(c), 1).over(w)).alias(f"{prefix}{c}") for c in cols])


def add_delta_features(df: DataFrame, cols: Sequence[str], prefix: str = DELTA,
                       prev_prefix: str = PREV) -> DataFrame:
    """``delta_c = c - prev_c`` for each ``c`` that has a ``prev_c``."""
    have = set(df.columns)
    cur = [c for c in cols if c in have and f"{prev_prefix}{c}" in have]
    if not cur:
        return df
    return df.select("*", *[(col_ref(c).try_cast("double") - col_ref(f"{prev_prefix}{c}").try_cast("double"))
                            .alias(f"{prefix}{c}") for c in cur])


def rank_in_period(df: DataFrame, period_col: str | Sequence[str], score_col: str,
                   tiebreak: Sequence[str], out_col: str = "rank", *, blocks: int | None = None) -> DataFrame:
    """1..n by score descending inside each period; ties go to the lower
    ``tiebreak`` (T7: the ordering must end with a unique key).  NULL score ->
    NULL rank, and NULL-score rows do not push others down.  Exact at any size:
    positions come from range-partitioned running counts, not from a window
    over the whole period."""
    order = [(score_col, False)] + [(t, True) for t in tiebreak]
    # nulls come last, so they push nobody down
    ranked = row_positions(df, _as_list(period_col), order, out_col, blocks=blocks)
    return ranked.withColumn(out_col, F.when(col_ref(score_col).isNotNull(), col_ref(out_col)))


def top_k_per_period(df: DataFrame, period_col: str | Sequence[str], score_col: str,
                     tiebreak: Sequence[str], k: int, out_col: str = "rank") -> DataFrame:
    """K1: the k best rows per period with their rank.  ``row_number() <= k``
    lets Spark plan a partial group limit before the shuffle, so only k rows
    per input partition and period are moved."""
    groups = _as_list(period_col)
    w = Window.partitionBy(*groups).orderBy(F.col(score_col).desc(), *[F.col(t).asc_nulls_first() for t in tiebreak])
    return (df.where(F.col(score_col).isNotNull())
            .withColumn(out_col, F.row_number().over(w).cast("long"))
            .where(F.col(out_col) <= k))


def _percentiles(df: DataFrame, groups: Sequence[str], cols: Sequence[str], names: Sequence[str],
                 blocks: int | None) -> DataFrame:
    """``df`` and, for each column, average rank / count among the group's non-null
    values, under ``names``.

    The rows are written once with a number; (number, group, column, value) goes
    through one ordered pass for all columns, and one grouped pivot on the number
    brings the percentiles back.  The shuffles do not grow with the columns, and
    no join is on a value.  Values keep their own type: one field per type."""
    types = {c: df.schema[c].dataType for c in df.columns}
    at = {c: f"c{i}" for i, c in enumerate(df.columns) if not isinstance(types[c], T.NullType)}
    rows = with_row_id(df.select(*[col_ref(c).alias(a) for c, a in at.items()]), "rid")
    ranked_cols = [c for c in cols if c in at]
    kinds = list(dict.fromkeys(types[c] for c in ranked_cols))

    def entry(i: int, c: str) -> Column:
        typed = [(F.col(at[c]) if kind == types[c] else F.lit(None).cast(kind)).alias(f"t{k}")
                 for k, kind in enumerate(kinds)]
        return F.struct(F.lit(i).alias("f"), F.when(F.col(at[c]).isNotNull(), F.struct(*typed)).alias("v"))

    out = rows
    if ranked_cols:
        keys = [f"k{i}" for i in range(len(groups))]
        long = rows.select("rid", *[F.col(at[g]).alias(k) for g, k in zip(groups, keys)], F.explode(F.array(*[
            entry(i, c) for i, c in enumerate(ranked_cols)])).alias("x")).select("rid", *keys, "x.f", "x.v")
        ranked = average_ranks(long, ["f", *keys], F.col("v"), blocks=blocks)
        pct = (F.col("_before") + 1 + F.col("_through")).cast("double") / 2.0 / F.col("_total").cast("double")
        wide = ranked.select("rid", "f", pct.alias("pct")).groupBy("rid").agg(
            *[F.max(F.when(F.col("f") == i, F.col("pct"))).alias(f"p{i}") for i in range(len(ranked_cols))])
        out = rows.join(wide, "rid", "left")
    place = {c: f"p{i}" for i, c in enumerate(ranked_cols)}
    return out.select(*[(F.col(at[c]) if c in at else F.lit(None)).alias(c) for c in df.columns],
                      *[(F.col(place[c]) if c in place else F.lit(None).cast("double")).alias(n)
                        for c, n in zip(cols, names)])


def percent_rank_avg(df: DataFrame, period_col: str | Sequence[str], cols: Sequence[str] | str,
                     suffix: str = "_pct", names: Sequence[str] | None = None, *,
                     blocks: int | None = None) -> DataFrame:
    """Pandas ``rank(pct=True, method="average")`` per period: average
    1-based rank among non-null values divided by the non-null count, in
    (0, 1]; NULL stays NULL.  One ordered pass for all columns; a value that half
    the rows hold fills many bounded blocks."""
    cols = _as_list(cols)
    names = list(names) if names else [f"{c}{suffix}" for c in cols]
    return _percentiles(df, _as_list(period_col), cols, names, blocks) if cols else df


def add_volume_features(df: DataFrame, period_col: str, award: str,
                        cols: Sequence[str] = ("G", "GS", "MP", "MPG"),
                        minutes_col: str = "MP", low_cut: float = 0.10) -> DataFrame:
    """``{c}_vol_pct`` (W4) for the volume columns present and
    ``low_volume_flag`` = percentile of minutes < ``low_cut``; the rookie award
    is returned unchanged."""
    if award.lower().strip() == "roy":
        return df
    present = [c for c in cols if c in df.columns]
    if not present:
        return df
    out = percent_rank_avg(df, period_col, present, suffix="_vol_pct")
    if minutes_col in present:
        out = out.withColumn("low_volume_flag",
                             F.coalesce(F.col(f"{minutes_col}_vol_pct") < F.lit(low_cut), F.lit(False)).cast("int"))
    return out


def best_per_group(df: DataFrame, group_cols: Sequence[str], crit_col: str,
                   tiebreak: Sequence[str] = ()) -> DataFrame:
    """The best row per group: highest ``crit_col`` (NULL last), then
    lowest ``tiebreak``, then the other columns in order.  ``row_number() = 1``
    plans a group limit before the shuffle, so a task sends one row per group;
    values are compared in their own type."""
    group_cols = _as_list(group_cols)
    w = Window.partitionBy(*[col_ref(g) for g in group_cols]).orderBy(
        col_ref(crit_col).desc_nulls_last(), *[col_ref(t).asc_nulls_first() for t in tiebreak],
        *[col_ref(c).asc_nulls_first() for c in df.columns if c not in {crit_col, *group_cols, *tiebreak}
          and not isinstance(df.schema[c].dataType, T.MapType)])
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").select(*[
        col_ref(c) for c in [*group_cols, *[c for c in df.columns if c not in group_cols]]])


def _distinct_periods(df: DataFrame, period_col: str) -> DataFrame:
    return df.select(period_col).where(F.col(period_col).isNotNull()).distinct()


def temporal_split_last_k(df: DataFrame, period_col: str, val_periods: int = 3, test_periods: int = 3,
                          out_col: str = "split", check: bool = True) -> DataFrame:
    """The last ``test_periods`` distinct periods are ``test``, the
    ``val_periods`` before them ``val``, the rest ``train``.  Raises when there
    are fewer than ``val + test + 1`` periods (``check``).  The ranking runs on
    the distinct-period table (one row per period), then joins back.  As the check
    runs a job of its own, ``df`` is computed once for it and what follows (a
    reliable checkpoint); without it the plan stays lazy."""
    if check:
        df = cut_lineage(df)
    periods = _distinct_periods(df, period_col)
    if check:
        n = periods.count()
        if n < val_periods + test_periods + 1:
            raise ValueError(f"need at least {val_periods + test_periods + 1} distinct periods, got {n}")
    # the distinct-period table has one row per period: a single ordered window is fine here
    ranked = periods.withColumn("__r", F.dense_rank().over(Window.orderBy(F.col(period_col).desc())))
    lab = ranked.select(F.col(period_col).alias("__p"),
                        F.when(F.col("__r") <= test_periods, "test")
                        .when(F.col("__r") <= test_periods + val_periods, "val").otherwise("train").alias(out_col))
    return join_summary(df, lab, [(period_col, "__p")]).drop("__p")


def temporal_split_cutoff(df: DataFrame, period_col: str, train_end: int = 2018, val_end: int = 2021,
                          out_col: str = "split") -> DataFrame:
    """Train <= ``train_end`` < val <= ``val_end`` < test."""
    p = F.col(period_col)
    return df.withColumn(out_col, F.when(p <= train_end, "train").when(p <= val_end, "val")
                         .when(p.isNotNull(), "test"))


def _per_period(df: DataFrame, period_col: str, label_col: str) -> DataFrame:
    """(p, n_rows, n_pos): one row per distinct period."""
    return (df.where(col_ref(period_col).isNotNull()).groupBy(col_ref(period_col).alias("p"))
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(F.coalesce(col_ref(label_col).cast("long"), F.lit(0))).alias("n_pos")))


def walk_forward_folds(df: DataFrame, period_col: str, label_col: str,
                       first_period: int | None = None, last_period: int | None = None) -> DataFrame:
    """Fold table.  For every test period s (optionally within
    [first, last]): train = all periods < s, test = s; folds whose train part
    has no positive are dropped.  Output: one row per (fold, period) with the
    role, the rows and the positives of that period: a running list over the
    per-period table (one row per period), without a join."""
    upto = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    folds = _per_period(df, period_col, label_col).select(
        F.col("p").alias("fold"), F.collect_list(F.struct("p", "n_rows", "n_pos")).over(upto).alias("parts"),
        F.sum("n_pos").over(earlier).alias("train_pos"))
    folds = folds.where(F.col("train_pos") > 0)
    if first_period is not None:
        folds = folds.where(F.col("fold") >= first_period)
    if last_period is not None:
        folds = folds.where(F.col("fold") <= last_period)
    role = F.when(F.col("x.p") == F.col("fold"), "test").otherwise("train")
    return folds.select("fold", F.explode("parts").alias("x")).select(
        "fold", F.col("x.p").alias(period_col), role.alias("role"), "x.n_rows", "x.n_pos")


LEARNING_FRACTIONS = (0.2, 0.4, 0.6, 0.8, 1.0)


def learning_curve_folds(df: DataFrame, period_col: str, label_col: str,
                         fracs: Sequence[float] = LEARNING_FRACTIONS, min_train_periods: int = 3,
                         min_pos: int = 1) -> DataFrame:
    """For each fraction f, train on the first ``ceil(f * n)`` distinct
    periods (earliest first).  One row per fraction with the size of the
    training part and a status: ``ok``, ``too_few_periods``, ``single_class``
    or ``too_few_positives``."""
    # the per-period table has one row per distinct period, so ordered windows
    # without a partition key touch only that small table
    per = _per_period(df, period_col, label_col).select(
        "*", F.row_number().over(Window.orderBy("p")).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    # a period belongs to every fraction whose cut covers it
    cuts = per.select("p", "n_rows", "n_pos", "i", "n", F.explode(F.array(*[F.lit(float(f)) for f in fracs])).alias("frac"))
    agg = (cuts.where(F.col("i") <= F.ceil(F.col("frac") * F.col("n"))).groupBy("frac")
           .agg(F.count(F.lit(1)).alias("n_periods"), F.max("p").alias("periods_max"),
                F.sum("n_rows").alias("n_train_rows"), F.sum("n_pos").alias("n_pos")))
    agg = agg.withColumn("n_neg", F.col("n_train_rows") - F.col("n_pos"))
    status = (F.when(F.col("n_periods") < min_train_periods, "too_few_periods")
              .when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), "single_class")
              .when(F.col("n_pos") < min_pos, "too_few_positives").otherwise("ok"))
    return agg.withColumn("status", status)


def group_zscore(df: DataFrame, period_col: str, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """U4: ``(x - mean) / sample std`` within the period; NULL when the std is
    0 or undefined.  Mean and std come from one grouped aggregation joined
    back (partial aggregation, so a big period is not one task)."""
    cols = _as_list(cols)
    stats = df.groupBy(period_col).agg(
        *[F.avg(col_ref(c)).alias(f"__m{i}") for i, c in enumerate(cols)],
        *[F.stddev_samp(col_ref(c)).alias(f"__s{i}") for i, c in enumerate(cols)])
    j = join_summary(df, stats.withColumnRenamed(period_col, "__p"), [(period_col, "__p")])
    z = [F.try_divide(col_ref(c).cast("double") - F.col(f"__m{i}"), F.nullif(F.col(f"__s{i}"), F.lit(0.0)))
         .alias(f"{c}{suffix}") for i, c in enumerate(cols)]
    return j.select(*[col_ref(c) for c in df.columns], *z)


def season_percentiles(df: DataFrame, period_col: str, cols: Sequence[str], key_cols: Sequence[str] = (),
                       prefix: str = "pct_", *, blocks: int | None = None) -> DataFrame:
    """``pct_c`` = W4 percentile of every listed column within its period, for
    many columns in one pass.  ``key_cols`` is not needed any more: rows are told
    apart by a number of their own, so repeated rows are no problem."""
    cols = list(cols)
    return percent_rank_avg(df, period_col, cols, names=[f"{prefix}{c}" for c in cols], blocks=blocks)
