"""Readers (S1-S5).

All readers return lazy DataFrames; the only driver-side work is listing
paths and choosing between them (schema and file-system metadata, no job).
"""

from __future__ import annotations

import operator
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import nan_to_null


COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq}


def read_facts(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None,
               where: Sequence[tuple] = ()) -> DataFrame:
    """Read a Parquet fact table and turn floating NaN into NULL once, at
    the scan (trap T1: in Spark NaN compares above every number).  Passing
    ``columns`` prunes the scan to those columns.

    ``where`` has comparisons (column, one of > >= < <= =, value) that all must hold.
    They are put on the stored column, where Parquet can skip row groups, and again
    on the column without NaN: a stored NaN may pass the first, never the second."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    tests = [COMPARE[op](F.col(f"`{c}`"), F.lit(value)) for c, op, value in where]
    for t in tests:
        df = df.where(t)
    df = nan_to_null(df)
    for t in tests:
        df = df.where(t)
    return df if columns is None else df.select(*[F.col(f"`{c}`") for c in columns])


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   header: bool = True) -> DataFrame:
    """CSV with a header row.  Give an explicit schema in production; with
    no schema every column is read as a string (no inference pass over the
    data)."""
    r = spark.read.option("header", header).option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def read_first_existing(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """S3: read the first path that exists, else raise ``FileNotFoundError``
    listing all candidates."""
    for p in paths:
        if _exists(spark, p):
            return nan_to_null(spark.read.format(fmt).load(p))
    raise FileNotFoundError("none of the candidate datasets exists: " + ", ".join(paths))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


_ASOF_PREFIX = re.compile(r"^(asof[_=])+", re.IGNORECASE)


def normalize_snapshot_name(snapshot: str) -> str:
    """Accept ``2025-01-31`` as well as ``asof_2025-01-31`` or
    ``asof=2025-01-31``; returns the bare date text."""
    return _ASOF_PREFIX.sub("", str(snapshot).strip())


def read_latest_snapshot(spark: SparkSession, root: str, snapshot: str | None = None,
                         partition_col: str = "asof") -> DataFrame:
    """A table partitioned by ``asof=YYYY-MM-DD``; keep the newest
    partition, or the named one.  The filter is on the partition column, so
    the scan lists and reads only that folder (partition pruning).  The newest
    value comes from the partition listing, not from a scan of the data."""
    df = spark.read.parquet(root)
    if snapshot is not None:
        day = normalize_snapshot_name(snapshot)
        return nan_to_null(df.where(F.col(partition_col) == F.lit(day).cast("date")))
    latest = _latest_partition_value(spark, root, partition_col)
    if latest is None:
        raise FileNotFoundError(f"no {partition_col}= partitions under {root}")
    return nan_to_null(df.where(F.col(partition_col) == F.lit(latest).cast("date")))


def _latest_partition_value(spark: SparkSession, root: str, partition_col: str) -> str | None:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(root)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    best = None
    for st in fs.listStatus(jpath):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(partition_col + "="):
            v = name.split("=", 1)[1]
            if re.fullmatch(r"\d{4}-\d{2}-\d{2}", v) and (best is None or v > best):
                best = v
    return best


RUN_ID_PATTERN = r"^\d{8}_\d{6}$"


def latest_runs(runs: DataFrame, group_cols: Sequence[str] = ("award",), run_col: str = "run_id") -> DataFrame:
    """Keep, per group, only the rows of the newest run id; run ids must
    look like ``YYYYMMDD_HHMMSS`` (others are ignored).  The ids sort as text.
    One aggregation (partial, then a tiny shuffle) and a join back."""
    group_cols = list(group_cols)
    valid = runs.where(F.col(run_col).rlike(RUN_ID_PATTERN))
    newest = valid.groupBy(*group_cols).agg(F.max(run_col).alias("__newest"))
    return (valid.join(newest, on=group_cols, how="inner")
            .where(F.col(run_col) == F.col("__newest")).drop("__newest"))


def read_latest_run(spark: SparkSession, root: str, group_cols: Sequence[str] = ("award",),
                    run_col: str = "run_id", fmt: str = "parquet") -> DataFrame:
    """S5 over a table written partitioned by ``award`` and ``run_id``
    (Parquet winner ranks, or ``fmt="json"`` for the metrics records)."""
    # only the newest run of each group is listed and read
    paths = list(newest_runs(spark, root, group_cols, run_col).values())
    if not paths:
        raise FileNotFoundError(f"no {run_col}= partitions under {root}")
    df = spark.read.option("basePath", root).format(fmt).load(paths)
    return nan_to_null(df.withColumn(run_col, F.col(run_col).cast("string")))


def newest_runs(spark: SparkSession, root: str, group_cols: Sequence[str] = ("award",),
                run_col: str = "run_id") -> dict[tuple[str, ...], str]:
    """Group values -> folder of the group's newest run, from the listing alone."""
    newest: dict[tuple[str, ...], str] = {}
    for folder in partition_folders(spark, root, list(group_cols)):
        runs = [f for f in partition_folders(spark, folder, [run_col])
                if re.fullmatch(RUN_ID_PATTERN, f.rpartition("=")[2])]
        if runs:
            values = [part.partition("=")[2] for part in folder.split("/")[-len(group_cols):]]
            newest[tuple(values)] = max(runs)
    return newest


def partition_folders(spark: SparkSession, root: str, columns: list[str]) -> list[str]:
    """Partition folders below ``root``, one level for each column."""
    found = [root.rstrip("/")]
    for c in columns:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = [str(st.getPath()) for at in found
                 for st in path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path(at))
                 if st.isDirectory() and st.getPath().getName().startswith(f"{c}=")]
    return found
