"""Eligibility filters.

Every rule treats NULL as 0 and is skipped when its column is absent, as in
the reference, unless noted.  Thresholds are parameters; the defaults are the
reference's values.  Data-dependent rules (E1's per-game switch, E7's rookie
fallback) are evaluated **per period** (trap T5), with exact statistics from
grouped aggregations joined back, never with a whole-table collect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col_ref, safe_ratio
from .ordering import _ALL, exact_quantiles, join_summary

# ---------------------------------------------------------------------------
# Fixed values (the reference's thresholds)
# ---------------------------------------------------------------------------
AWARDS = ["mvp", "dpoy", "smoy", "roy", "mip"]
MPG_MIN = {"mvp": 25, "dpoy": 20, "roy": 0, "smoy": 0, "mip": 0}
G_MIN = {"dpoy": 40}
BENCH_RATIO = 0.5
MIP_MIN_G = 20
MIP_MIN_MPG = 15
MIP_PREV_CANDIDATES = ["prev_MP", "prev_pct_MP"]
# per-game detection: MP is already per game when median(MP/G) < 3 and 5 <= median(MP) <= 45
PER_GAME_MEDIAN_MPG_BELOW = 3.0
PER_GAME_MEDIAN_MP_RANGE = (5.0, 45.0)
# ---------------------------------------------------------------------------


def _num(df: DataFrame, c: str) -> Column:
    return col_ref(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")


def _z(e: Column) -> Column:
    return F.coalesce(e, F.lit(0.0))


def per_game_minutes(df: DataFrame, out_col: str = "__mpg", period_col: str | None = None,
                     mp: str = "MP", g: str = "G", mp_per_g: str = "MP_per_g") -> DataFrame:
    """Add minutes per game.  ``MP_per_g`` if present; else ``MP / G``
    (G = 0 -> NULL) unless, within the period, median(MP/G) < 3 and
    5 <= median(MP) <= 45, in which case MP already is per game; else ``MP``;
    else NULL.  The two medians are exact and per period, computed together
    in one grouped pass over (period, column) and joined back."""
    if mp_per_g in df.columns:
        return df.withColumn(out_col, _num(df, mp_per_g))
    if mp not in df.columns:
        return df.withColumn(out_col, F.lit(None).cast("double"))
    if g not in df.columns:
        return df.withColumn(out_col, _num(df, mp))
    grp = period_col if period_col else _ALL
    base = df if period_col else df.withColumn(_ALL, F.lit(0))
    ratio = safe_ratio(mp, g)
    # both medians in one pass: (period, which, value) rows, grouped by (period, which)
    vals = base.select(grp, F.explode(F.array(
        F.struct(F.lit("r").alias("w"), ratio.alias("v")),
        F.struct(F.lit("m").alias("w"), _num(df, mp).alias("v")))).alias("__wv"))
    vals = vals.select(grp, F.col("__wv.w").alias("__w"), F.col("__wv.v").alias("__v"))
    med = exact_quantiles(vals, [grp, "__w"], "__v", [0.5], ["__med"])
    meds = med.groupBy(F.col(grp).alias("__grp")).agg(
        F.max(F.when(F.col("__w") == "r", F.col("__med"))).alias("__med_r"),
        F.max(F.when(F.col("__w") == "m", F.col("__med"))).alias("__med_m"))
    lo, hi = PER_GAME_MEDIAN_MP_RANGE
    already = ((F.col("__med_r") < PER_GAME_MEDIAN_MPG_BELOW)
               & (F.col("__med_m") >= lo) & (F.col("__med_m") <= hi))
    j = join_summary(base, meds, [(grp, "__grp")])
    val = F.when(F.coalesce(already, F.lit(False)), _num(df, mp)).otherwise(ratio)
    return j.select(*[col_ref(c) for c in df.columns], val.alias(out_col))


def bench_proxy(df: DataFrame, g: str = "G", gs: str = "GS", ratio: float = BENCH_RATIO) -> Column:
    """``GS/G < 0.5``; missing columns or G = 0 give ratio 0, which passes."""
    r = F.try_divide(_num(df, gs), F.nullif(_num(df, g), F.lit(0.0)))
    return _z(r) < F.lit(ratio)


def min_volume(df: DataFrame, award: str, period_col: str | None = None,
               mpg_min: float | None = None, g_min: float | None = None,
               mp: str = "MP", g: str = "G", mp_per_g: str = "MP_per_g") -> DataFrame:
    """Minutes per game >= ``mpg_min`` (mvp 25, dpoy 20, others off) and
    games >= ``g_min`` (dpoy 40; skipped without a G column)."""
    a = award.lower().strip()
    mpg_min = MPG_MIN.get(a, 0) if mpg_min is None else mpg_min
    g_min = G_MIN.get(a, 0) if g_min is None else g_min
    out = df
    if mpg_min > 0:
        out = per_game_minutes(out, "__mpg", period_col, mp, g, mp_per_g)
        out = out.where(_z(F.col("__mpg")) >= F.lit(float(mpg_min))).drop("__mpg")
    if g_min > 0 and g in out.columns:
        out = out.where(_z(_num(out, g)) >= F.lit(float(g_min)))
    return out


def _positive_minutes(df: DataFrame, mp: str = "MP") -> DataFrame:
    if mp in df.columns:
        return df.where(_z(_num(df, mp)) > 0)
    return df


def eligible_mvp(df: DataFrame, period_col: str | None = None, mpg_min: float | None = None,
                 mp: str = "MP", g: str = "G", mp_per_g: str = "MP_per_g") -> DataFrame:
    """MP > 0, then E3 (mvp)."""
    return min_volume(_positive_minutes(df, mp), "mvp", period_col, mpg_min, None, mp, g, mp_per_g)


def eligible_dpoy(df: DataFrame, period_col: str | None = None, mpg_min: float | None = None,
                  g_min: float | None = None, mp: str = "MP", g: str = "G",
                  mp_per_g: str = "MP_per_g") -> DataFrame:
    """E5: MP > 0, then E3 (dpoy)."""
    return min_volume(_positive_minutes(df, mp), "dpoy", period_col, mpg_min, g_min, mp, g, mp_per_g)


def eligible_smoy(df: DataFrame, period_col: str | None = None, mp: str = "MP", g: str = "G",
                  gs: str = "GS", mpg_min: float | None = None, mp_per_g: str = "MP_per_g") -> DataFrame:
    """Bench proxy (E2), then MP > 0, then E3 (off by default)."""
    out = _positive_minutes(df.where(bench_proxy(df, g, gs)), mp)
    return min_volume(out, "smoy", period_col, mpg_min, None, mp, g, mp_per_g)


def eligible_roy(df: DataFrame, period_col: str, rookie_col: str = "is_rookie",
                 rookies: DataFrame | None = None, name_col: str = "Player",
                 rookie_name_col: str = "Player", mpg_min: float | None = None,
                 mp: str = "MP", g: str = "G", mp_per_g: str = "MP_per_g") -> DataFrame:
    """Rows flagged ``is_rookie == 1``.  In a period where nobody is
    flagged, fall back to names in the rookie list (trimmed); without a list
    keep the whole period.  The "anyone flagged?" test is a per-period
    aggregate joined back; the list match is a left-semi join on the distinct
    trimmed names (a broadcast when adaptive execution sees it is small)."""
    ids = [col_ref(c) for c in df.columns]
    flag, someone, j = F.lit(False), F.lit(False), df
    if rookie_col in df.columns:
        flag = F.coalesce(col_ref(rookie_col).try_cast("double").cast("int"), F.lit(0)) == 1
        any_flag = df.groupBy(col_ref(period_col).alias("__p")).agg(F.max(flag.cast("int")).alias("__any"))
        j = join_summary(df, any_flag, [(period_col, "__p")])
        someone = F.coalesce(F.col("__any"), F.lit(0)) == 1
    listed = F.lit(True)
    if rookies is not None and rookie_name_col in rookies.columns and name_col in df.columns:
        names = (rookies.select(F.trim(col_ref(rookie_name_col).cast("string")).alias("__name"))
                 .where("__name is not null").distinct())
        # an empty list is no list; that is settled inside the plan
        empty = names.agg(F.count(F.lit(1)) == 0).scalar()
        j = j.join(names, F.trim(col_ref(name_col).cast("string")) == F.col("__name"), "left")
        listed = F.col("__name").isNotNull() | empty
    out = j.where((someone & flag) | (~someone & listed)).select(*ids)
    return min_volume(out, "roy", period_col, mpg_min, None, mp, g, mp_per_g)


def eligible_mip(df: DataFrame, period_col: str | None = None, rookie_col: str = "is_rookie",
                 min_g: float = MIP_MIN_G, min_mpg: float = MIP_MIN_MPG,
                 prev_candidates: Sequence[str] = tuple(MIP_PREV_CANDIDATES),
                 mp: str = "MP", g: str = "G", mp_per_g: str = "MP_per_g") -> DataFrame:
    """Not a rookie; G >= 20; minutes per game >= 15 (always applied, so
    without minutes nobody passes); the first existing of ``prev_MP``,
    ``prev_pct_MP`` > 0."""
    out = df
    if rookie_col in out.columns:
        out = out.where(F.coalesce(col_ref(rookie_col).try_cast("double").cast("int"), F.lit(0)) == 0)
    if g in out.columns:
        out = out.where(_z(_num(out, g)) >= F.lit(float(min_g)))
    out = per_game_minutes(out, "__mpg", period_col, mp, g, mp_per_g)
    out = out.where(_z(F.col("__mpg")) >= F.lit(float(min_mpg))).drop("__mpg")
    prev = [c for c in prev_candidates if c in out.columns]
    if prev:
        out = out.where(_z(_num(out, prev[0])) > 0)
    return out


RULES = {"mvp": eligible_mvp, "dpoy": eligible_dpoy, "smoy": eligible_smoy, "roy": eligible_roy,
         "mip": eligible_mip}


def apply_eligibility(df: DataFrame, award: str, period_col: str | None = None,
                      rookies: DataFrame | None = None, **kw) -> DataFrame:
    """Dispatch on the lower-cased, trimmed award name."""
    a = str(award).lower().strip()
    if a not in RULES:
        raise ValueError(f"unknown award: {award!r}")
    if a == "roy":
        kw["rookies"] = rookies
        if period_col is None:
            return eligible_roy(df.withColumn(_ALL, F.lit(0)), _ALL, **kw).drop(_ALL)
    return RULES[a](df, period_col=period_col, **kw)


def eligible_smoy_strict(df: DataFrame, g: str = "G", gs: str = "GS") -> DataFrame:
    """E10 (notebook variant): ``GS <= G - GS``; a NULL fails."""
    return df.where(F.coalesce(_num(df, gs) <= _num(df, g) - _num(df, gs), F.lit(False)))


def eligible_mip_strict(df: DataFrame, entity_col: str, period_col: str, g: str = "G",
                        rookie_col: str = "is_rookie", min_g: float = MIP_MIN_G,
                        min_g_prev: float = MIP_MIN_G) -> DataFrame:
    """E11 (notebook variant): a row for period N-1 exists (strict previous
    period, J1), not a rookie, G >= ``min_g`` now and >= ``min_g_prev`` in N-1.
    Adds the audit columns ``prev_G`` and ``mip_has_prev_season``."""
    from .joins import prev_period_join
    j = prev_period_join(df, entity_col, period_col, [g], prefix="prev_", flag_col="mip_has_prev_season")
    not_rookie = F.coalesce(col_ref(rookie_col).try_cast("double").cast("int"), F.lit(0)) != 1 \
        if rookie_col in df.columns else F.lit(True)
    meets = (_z(_num(j, g)) >= min_g) & (_z(col_ref(f"prev_{g}").try_cast("double")) >= min_g_prev)
    return j.where((F.col("mip_has_prev_season") == 1) & not_rookie & meets)


def period_between(df: DataFrame, period_col: str, lo, hi) -> DataFrame:
    """Inclusive range filter (pushed into the scan when it is a column
    of the file)."""
    return df.where(F.col(period_col).between(lo, hi))


def drop_invalid_periods(df: DataFrame, period_col: str, label_col: str, wanted: int = 1) -> DataFrame:
    """Keep only periods with exactly ``wanted`` positives (label NULL = 0).
    A grouped sum and a left-semi join."""
    y = F.coalesce(col_ref(label_col).try_cast("double"), F.lit(0.0))
    ok = (df.groupBy(period_col).agg(F.sum(y).alias("__s"))
          .where(F.col("__s") == float(wanted)).select(F.col(period_col).alias("__p")))
    return join_summary(df, ok, [(period_col, "__p")], "inner").where(col_ref(period_col).isNotNull()).drop("__p")


def complete_cases(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    """Drop rows with a NULL in any (or all) of ``subset``."""
    return df.na.drop(how=how, subset=list(subset) if subset else None)


def missing_rates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL share per column, one aggregation over all columns, then an
    unpivot of the single result row; sorted descending."""
    cols = list(cols) if cols else list(df.columns)
    one = df.agg(*[F.avg(col_ref(c).isNull().cast("double")).alias(c) for c in cols])
    long = one.unpivot([], [col_ref(c) for c in cols], "column", "missing_rate") if cols else one
    return long.orderBy(F.col("missing_rate").desc(), F.col("column"))


def missing_rate_filter(df: DataFrame, threshold: float = 0.2, cols: Sequence[str] | None = None) -> DataFrame:
    """The columns whose NULL share exceeds ``threshold``."""
    return missing_rates(df, cols).where(F.col("missing_rate") > threshold)

