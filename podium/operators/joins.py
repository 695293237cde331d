"""Joins and set membership."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col_ref
from .windows import entity_window


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J2 (report form): the keys that repeat, with their number of rows ``n``."""
    return df.groupBy(*[col_ref(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique_key(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise ``ValueError`` when a key repeats.  One grouped count; only
    one offending key is brought back."""
    dup = (df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect())
    if dup:
        raise ValueError(f"duplicate key {tuple(dup[0][k] for k in keys)} in columns {list(keys)}")


def prev_period_join(df: DataFrame, entity_col: str, period_col: str, cols: Sequence[str],
                     prefix: str = "prev_", flag_col: str | None = None,
                     validate: bool = True) -> DataFrame:
    """Values of *exactly* period N-1 for the same entity (NULL when the
    entity skipped N-1; T8: not the previous row).  Equal to a left join of
    the table with itself shifted by one period.  (entity, period) must be
    unique; ``validate`` raises when the query runs on a table where it is not,
    as the reference's one-to-one merge does.  Computed with one entity window
    (lag plus a gap check) over one scan instead of a self-join."""
    w = entity_window(df, entity_col).orderBy(col_ref(period_col).asc_nulls_first())
    known = col_ref(entity_col).isNotNull()
    before = F.lag(col_ref(period_col), 1).over(w)
    strict = known & (before == col_ref(period_col) - F.lit(1))
    if validate:
        strict = F.when(known & (before == col_ref(period_col)), F.raise_error(F.concat(
            F.lit(f"duplicate key in columns [{entity_col}, {period_col}]: "), col_ref(entity_col).cast("string"),
            F.lit(", "), col_ref(period_col).cast("string"))).cast("boolean")).otherwise(strict)
    outs = [F.when(strict, F.lag(col_ref(c), 1).over(w)).alias(f"{prefix}{c}") for c in cols]
    if flag_col:
        outs.append(F.coalesce(strict, F.lit(False)).cast("int").alias(flag_col))
    return df.select(*[col_ref(c) for c in df.columns], *outs)


def row_id_join(left: DataFrame, right: DataFrame, row_id_col: str = "__row_id", how: str = "inner") -> DataFrame:
    """Attach columns of ``right`` by an explicit row id."""
    return left.join(right, row_id_col, how)


def _distinct_trimmed(names: DataFrame, name_col: str) -> DataFrame:
    return (names.select(F.trim(col_ref(name_col).cast("string")).alias("__member"))
            .where(F.col("__member").isNotNull()).distinct())


def flag_members(df: DataFrame, names: DataFrame, df_name_col: str = "Player",
                 list_name_col: str = "Player", flag_col: str = "is_rookie") -> DataFrame:
    """``flag_col`` = 1 when the trimmed name is in the list, else 0; the
    flag is **overwritten** (T11).  Duplicates in the list are folded by a
    ``distinct`` first, so the left join cannot multiply rows."""
    members = _distinct_trimmed(names, list_name_col)
    j = df.join(members, F.trim(col_ref(df_name_col).cast("string")) == F.col("__member"), "left")
    keep = [col_ref(c) for c in df.columns if c != flag_col]
    return j.select(*keep, F.col("__member").isNotNull().cast("int").alias(flag_col))


def semi_filter(df: DataFrame, col: str, values, values_col: str | None = None,
                anti: bool = False) -> DataFrame:
    """Keep rows whose ``col`` is in ``values`` (a Python list -> ``isin``;
    a DataFrame -> left-semi join on its ``values_col``)."""
    if isinstance(values, DataFrame):
        vc = values_col or values.columns[0]
        v = values.select(col_ref(vc).alias("__v")).distinct()
        return df.join(v, col_ref(col) == F.col("__v"), "left_anti" if anti else "left_semi")
    cond = col_ref(col).isin(list(values))
    return df.where(~cond if anti else cond)


COMPARE_METRICS = ["val_mrr", "test_mrr", "val_top1", "test_top1"]


def compare_runs(baseline: DataFrame, tree: DataFrame, key: str = "award",
                 metrics: Sequence[str] = tuple(COMPARE_METRICS),
                 run_col: str | None = "run_id") -> DataFrame:
    """Inner match of two run tables by ``key``; per metric the baseline
    value, the tree value and ``delta = tree - baseline`` (NULL when either is
    NULL); sorted by the first delta, largest first."""
    def side(df, tag):
        cols = [col_ref(key)]
        if run_col and run_col in df.columns:
            cols.append(col_ref(run_col).alias(f"{tag}_run"))
        cols += [col_ref(m).cast("double").alias(f"{tag}_{m}") for m in metrics if m in df.columns]
        return df.select(*cols)

    b, t = side(baseline, "baseline"), side(tree, "tree")
    j = b.join(t, key, "inner")
    out = [col_ref(c) for c in j.columns]
    deltas = []
    for m in metrics:
        if f"baseline_{m}" in j.columns and f"tree_{m}" in j.columns:
            out.append((F.col(f"tree_{m}") - F.col(f"baseline_{m}")).alias(f"delta_{m}"))
            deltas.append(f"delta_{m}")
    res = j.select(*out)
    return res.orderBy(F.col(deltas[0]).desc_nulls_last(), col_ref(key)) if deltas else res


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """Stack tables by column name; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def audit_alignment(df: DataFrame, features: DataFrame, labels: DataFrame, keys: Sequence[str],
                    period_col: str, label_col: str) -> DataFrame:
    """One row of checks: row counts of the three tables, keys missing on
    either side (left-anti joins both ways) and periods whose positives are
    not exactly one."""
    def one(table: DataFrame, name: str) -> DataFrame:
        return table.agg(F.count(F.lit(1)).alias(name))

    k = [col_ref(c) for c in keys]
    kx, kd = features.select(*k), df.select(*k)
    per = (labels.groupBy(col_ref(period_col))
           .agg(F.sum(F.coalesce(col_ref(label_col).cast("double"), F.lit(0.0))).alias("__s")))
    counts = [one(df, "n_df"), one(features, "n_features"), one(labels, "n_labels"),
              one(kd.join(kx, list(keys), "left_anti"), "keys_missing_in_features"),
              one(kx.join(kd, list(keys), "left_anti"), "keys_missing_in_df"),
              one(per.where(F.col("__s") != 1.0), "periods_not_one_winner")]
    # one plan: the first count with the others as scalar subqueries
    return counts[0].select("*", *[c.scalar().alias(c.columns[0]) for c in counts[1:]])
