"""Schema shaping (P2, P8-P11, P13, P16) and the feature projection (F rules,
F9 audit)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import col_ref, parse_season_end

# ---------------------------------------------------------------------------
# Column-name drift accepted by the schema normaliser
# ---------------------------------------------------------------------------
TEAM_ALIASES = ["Team", "team", "tm"]
SEASON_ALIASES = ["year", "Year"]
IMPORTANCE_FEATURE_NAMES = ["feature", "name", "col"]
IMPORTANCE_VALUE_NAMES = ["importance_mean", "importance", "coef", "coefficient"]
# ---------------------------------------------------------------------------


def normalize_schema(df: DataFrame, team_col: str = "Tm", period_col: str = "season") -> DataFrame:
    """Rename drifted id columns (first alias present wins), parse the
    period to its end year (P3) and drop rows whose period does not parse."""
    out = df
    if team_col not in out.columns:
        for a in TEAM_ALIASES:
            if a in out.columns:
                out = out.withColumnRenamed(a, team_col)
                break
    if period_col not in out.columns:
        for a in SEASON_ALIASES:
            if a in out.columns:
                out = out.withColumnRenamed(a, period_col)
                break
    if period_col in out.columns:
        out = out.withColumn(period_col, parse_season_end(period_col)).where(F.col(period_col).isNotNull())
    return out


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop the listed columns that exist."""
    have = set(df.columns)
    return df.drop(*[c for c in cols if c in have])


def distinct_categories(df: DataFrame, col: str) -> list:
    """Distinct non-NULL values of a categorical column, sorted: they become the
    columns of the result, so the driver has to know them all."""
    vals = df.select(col_ref(col).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct().collect()
    return sorted(r["v"] for r in vals)


def one_hot(df: DataFrame, col: str, prefix: str | None = None, categories: Sequence[str] | None = None,
            null_as: str | None = "UNK", drop_source: bool = True) -> DataFrame:
    """0/1 integer columns ``{prefix}_{value}`` (D4: integers, kept).  The
    category list is global (D5: absent categories are 0, never NULL); by
    default it is read once from the data.  ``null_as="UNK"`` gives NULL its
    own column (matrix builder); ``null_as=None`` leaves all zeros (notebook
    variant)."""
    prefix = prefix or col
    cats = list(categories) if categories is not None else distinct_categories(df, col)
    v = col_ref(col).cast("string")
    if null_as is not None:
        v = F.coalesce(v, F.lit(null_as))
        if null_as not in cats:
            cats = sorted(set(cats) | {null_as})
    dummies = [F.coalesce((v == F.lit(c)).cast("int"), F.lit(0)).alias(f"{prefix}_{c}") for c in cats]
    keep = [col_ref(c) for c in df.columns if not (drop_source and c == col)]
    return df.select(*keep, *dummies)


def select_numeric(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """P10: keep numeric (and boolean) columns."""
    keep = [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in set(exclude)]
    return df.select(*[col_ref(c) for c in keep])


def align_features(df: DataFrame, feature_names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The model's training columns in their order: present columns are
    coerced to double, missing ones are 0.0, extras dropped.  ``keep`` columns
    (ids) are carried in front."""
    have = set(df.columns)
    feats = [col_ref(c).try_cast("double").alias(c) if c in have else F.lit(0.0).alias(c) for c in feature_names]
    return df.select(*[col_ref(k) for k in keep], *feats)


def to_percent_0_100(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Multiply a column by 100 when its (global) maximum is <= 1.  The
    maxima come from one aggregation used as a scalar subquery, so the
    operator stays lazy and needs no join."""
    cols = list(cols)
    if not cols:
        return df
    # all maxima in one aggregation, used as a scalar subquery (evaluated once)
    mx = df.agg(F.struct(*[F.max(col_ref(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)])).scalar()
    out = []
    for c in df.columns:
        if c in cols:
            x = col_ref(c).cast("double")
            out.append(F.when(mx.getField(f"m{cols.index(c)}") <= 1.0, x * 100.0).otherwise(x).alias(c))
        else:
            out.append(col_ref(c))
    return df.select(*out)


def normalize_importance(df: DataFrame) -> DataFrame:
    """Accept ``feature|name|col`` and ``importance_mean|importance|coef|
    coefficient`` (any case); output ``feature, value, std, abs_value`` sorted
    by ``abs_value`` descending."""
    lower = {c.lower(): c for c in df.columns}
    feat = next((lower[k] for k in IMPORTANCE_FEATURE_NAMES if k in lower), None)
    if feat is None:
        raise ValueError(f"no feature column among {df.columns}")
    val = next((lower[k] for k in IMPORTANCE_VALUE_NAMES if k in lower), None)
    if val is None:
        raise ValueError(f"no importance/coef column among {df.columns}")
    std = lower.get("importance_std") if val == lower.get("importance_mean") else None
    out = df.select(col_ref(feat).cast("string").alias("feature"), col_ref(val).cast("double").alias("value"),
                    (col_ref(std).cast("double") if std else F.lit(None).cast("double")).alias("std"))
    out = out.withColumn("abs_value", F.abs("value"))
    return out.orderBy(F.col("abs_value").desc_nulls_last(), "feature")


def select_features(df: DataFrame, rule: Callable[[list[str]], list[str]] | Sequence[str],
                    keep: Sequence[str] = ()) -> DataFrame:
    """The feature projection: ``keep`` columns plus the columns chosen by
    ``rule`` (a function of ``df.columns``, e.g. ``infer_percentile_cols``, or
    an explicit list resolved against the schema).  It is a plain projection,
    so Catalyst prunes the Parquet scan to these columns."""
    cols = rule(list(df.columns)) if callable(rule) else [c for c in rule if c in set(df.columns)]
    chosen = list(dict.fromkeys([*keep, *cols]))
    return df.select(*[col_ref(c) for c in chosen])


def feature_audit(df: DataFrame) -> DataFrame:
    """per column its type class and whether it is a text column, a
    list-like column or an all-NULL numeric column.  The all-NULL test is one
    aggregation of non-NULL counts over every numeric column."""
    spark = df.sparkSession
    fields = df.schema.fields
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    counts = df.agg(*[F.count(col_ref(c)).alias(f"n{i}") for i, c in enumerate(numeric)]).first() if numeric else None
    rows = []
    for f in fields:
        is_num = f.name in numeric
        nn = int(counts[f"n{numeric.index(f.name)}"]) if is_num else None
        rows.append((f.name, f.dataType.simpleString(), isinstance(f.dataType, T.StringType),
                     isinstance(f.dataType, (T.ArrayType, T.MapType)), bool(is_num and nn == 0)))
    return spark.createDataFrame(rows, "column string, type string, is_text boolean, "
                                       "is_list boolean, all_null_numeric boolean")
