"""Leakage checks (L1-L4).

Name rules run on the schema (no job).  Correlation checks unpivot the columns and
aggregate by feature in one pass; the result has one row per feature.  As a gate,
the check rides on the write of the table it checks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import name_leakage
from ..functions.scalar import col_ref

CORR_THRESHOLD = 0.95
MIN_NON_NULL = 25
MIN_STD = 1e-12


def _coercible(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Every column that may hold numbers: text is coerced, value by value."""
    kinds = (T.NumericType, T.BooleanType, T.StringType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in set(exclude)]


def _numeric(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in set(exclude)]


def _stats(x: Column, y: Column) -> dict[str, Column]:
    """Aggregates of a feature: non-NULL count, std over its non-NULL values, pairwise
    count and guarded Pearson correlation with the label (R4: covariance and
    both deviations over the same pairwise rows, ``try_divide`` so constant
    columns give NULL rather than an error, T3)."""
    xp, yp = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return {"n_non_null": F.count(x), "std": F.stddev_samp(x), "n_pairs": F.count(xp),
            "corr": F.try_divide(F.covar_samp(xp, yp), F.stddev_samp(xp) * F.stddev_samp(yp))}


def _feature_label_stats(df: DataFrame, label_col: str, cols: Sequence[str]) -> DataFrame:
    """One row per feature: its :func:`_stats` and the label's range.  The features of a
    row are unpivoted and aggregated by feature before the shuffle, so the plan is the
    same for three columns and for thousands."""
    cells = F.posexplode(F.array(*[col_ref(c).try_cast("double") for c in cols])).alias("at", "x")
    long = df.select(col_ref(label_col).try_cast("double").alias("y"), cells)
    st = long.groupBy("at").agg(F.min("y").alias("__ymin"), F.max("y").alias("__ymax"),
                                *[a.alias(k) for k, a in _stats(F.col("x"), F.col("y")).items()])
    names = F.array(*[F.lit(c) for c in cols])
    return st.select("__ymin", "__ymax", F.get(names, F.col("at")).alias("feature"), "n_non_null", "std", "n_pairs", "corr")


def corr_leakage(df: DataFrame, label_col: str, cols: Sequence[str] | None = None,
                 threshold: float = CORR_THRESHOLD, min_non_null: int = MIN_NON_NULL) -> DataFrame:
    """L2: Pearson correlation of each column with the label, text coerced to
    numbers; columns
    with fewer than ``min_non_null`` values or a std <= 1e-12 are skipped, and
    nothing is reported when the label is constant; returns (feature, corr)
    with |corr| >= threshold, strongest first."""
    cols = list(cols) if cols is not None else _coercible(df, [label_col])
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, corr double")
    st = _feature_label_stats(df, label_col, cols)
    keep = ((F.col("__ymin") < F.col("__ymax")) & (F.col("n_non_null") >= min_non_null)
            & (F.col("std") > MIN_STD) & F.col("corr").isNotNull() & ~F.isnan("corr")
            & (F.abs("corr") >= threshold))
    return st.where(keep).select("feature", "corr").orderBy(F.abs("corr").desc(), "feature")


def feature_label_corr(df: DataFrame, label_col: str, cols: Sequence[str] | None = None,
                       min_pairs: int = 10) -> DataFrame:
    """L4: |r| of every feature with the label, for features with at least
    ``min_pairs`` complete pairs and a non-zero std; strongest first."""
    cols = list(cols) if cols is not None else _numeric(df, [label_col])
    st = _feature_label_stats(df, label_col, cols)
    keep = (F.col("n_pairs") >= min_pairs) & (F.col("std") > 0) & F.col("corr").isNotNull()
    return (st.where(keep).select("feature", F.abs("corr").alias("abs_corr"), "corr")
            .orderBy(F.col("abs_corr").desc(), "feature"))


def leakage_report(df: DataFrame, label_col: str, award: str, cols: Sequence[str] | None = None,
                   threshold: float = CORR_THRESHOLD, strict_tokens: bool = False) -> DataFrame:
    """L3 (report form): name-based leaks (kind ``name``) and high correlations
    (kind ``corr``) as one small table."""
    cols = list(cols) if cols is not None else [c for c in df.columns if c != label_col]
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in name_leakage(cols, strict_tokens)], "feature string")
    names = names.select(F.lit("name").alias("kind"), "feature", F.lit(None).cast("double").alias("corr"))
    numeric = [c for c in _coercible(df, [label_col]) if c in set(cols)]
    corr = corr_leakage(df, label_col, numeric, threshold).select(F.lit("corr").alias("kind"), "feature", "corr")
    return names.unionByName(corr)


class LeakageError(RuntimeError):
    pass


def check_leakage(df: DataFrame, label_col: str, award: str, cols: Sequence[str] | None = None,
                  threshold: float = CORR_THRESHOLD, strict: bool = True,
                  split_col: str | None = None, split: str | None = "train") -> list[tuple[str, str, float | None]]:
    """L3: name-based + correlation leakage.  ``strict`` raises
    :class:`LeakageError` listing the names and the first 10 correlations;
    otherwise the findings are returned.  D7: with ``split_col`` only the
    ``split`` rows (train by default) are checked."""
    src = df.where(F.col(split_col) == split) if split_col and split is not None else df
    if cols is None:
        cols = [c for c in df.columns if c not in {label_col, split_col}]
    rows = [(r["kind"], r["feature"], r["corr"]) for r in leakage_report(src, label_col, award, cols, threshold).collect()]
    if rows and strict:
        raise LeakageError(_message(rows, award, threshold))
    return rows


def _message(rows: Sequence[tuple], award: str, threshold: float) -> str:
    names = [f for k, f, _ in rows if k == "name"]
    corrs = [(f, v) for k, f, v in rows if k == "corr"][:10]
    msg = [f"data leakage detected for award={award}"]
    if names:
        msg.append("name-based: " + ", ".join(sorted(names)))
    if corrs:
        msg.append(f"|corr| >= {threshold}: " + ", ".join(f"{f}={v:.3f}" for f, v in corrs))
    return "\n".join(msg)


def write_checked(df: DataFrame, path: str, label_col: str, award: str, cols: Sequence[str] | None = None,
                  threshold: float = CORR_THRESHOLD, strict: bool = True, split_col: str | None = None,
                  split: str | None = "train", min_non_null: int = MIN_NON_NULL,
                  partition_by: Sequence[str] = ()) -> list[tuple[str, str, float | None]]:
    """L3 as a gate on a table's own write: the statistics of :func:`check_leakage` are
    observed while ``df`` is written as Parquet to ``path`` (which must not exist), so
    the table is computed once, without a job before it.  ``strict`` raises
    :class:`LeakageError` -- for names before anything is written; for correlations
    after it, and the table just written is removed, so that nothing trains on it.
    Otherwise the findings are returned and the table stays."""
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in {label_col, split_col}]
    rows = [("name", c, None) for c in name_leakage(cols, False)]
    if rows and strict:
        raise LeakageError(_message(rows, award, threshold))
    checked = F.lit(True) if split_col is None or split is None else col_ref(split_col) == split
    y = F.when(checked, col_ref(label_col).try_cast("double"))
    numeric = [c for c in _coercible(df, [label_col]) if c in set(cols)]
    seen = Observation()
    aggs = [F.min(y).alias("ymin"), F.max(y).alias("ymax")]
    for i, c in enumerate(numeric):
        x = F.when(checked, col_ref(c).try_cast("double"))
        aggs += [a.alias(f"{k}{i}") for k, a in _stats(x, y).items()]
    df.observe(seen, *aggs).write.partitionBy(*partition_by).parquet(path)
    got = seen.get
    if got["ymin"] is not None and got["ymin"] < got["ymax"]:
        found = [(c, got[f"corr{i}"]) for i, c in enumerate(numeric)
                 if got[f"n_non_null{i}"] >= min_non_null and (got[f"std{i}"] or 0) > MIN_STD]
        found = [(c, r) for c, r in found if r is not None and abs(r) >= threshold]  # NaN is below
        rows += [("corr", c, r) for c, r in sorted(found, key=lambda p: (-abs(p[1]), p[0]))]
    if rows and strict:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        raise LeakageError(_message(rows, award, threshold))
    return rows
