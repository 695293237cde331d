"""Writers (S6-S8, S12) and snapshot tables.

One dataset per award, run or snapshot becomes one table partitioned by that
value, so readers prune folders instead of listing files by name.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_award_datasets(df: DataFrame, path: str, award_col: str = "award", mode: str = "overwrite") -> None:
    """All awards' datasets (ids, features, label) in one Parquet table
    partitioned by award (replaces the df / X / y file triple)."""
    df.write.mode(mode).partitionBy(award_col).parquet(path)


def write_predictions(scored: DataFrame, path: str, top_k: int = 10, award_col: str = "award",
                      rank_col: str = "rank", mode: str = "overwrite") -> None:
    """Every scored row as Parquet partitioned by award, plus the top-k
    rows per award as CSV, one file an award.  The second write reads the first, so
    scores are computed once (appending, it can't tell new rows from old)."""
    scored.write.mode(mode).partitionBy(award_col).parquet(f"{path}/all")
    if mode != "append":
        scored = scored.sparkSession.read.schema(scored.schema).parquet(f"{path}/all")
    top = scored.where(F.col(rank_col) <= top_k)
    top.repartition(award_col).write.mode(mode).option("header", True).partitionBy(award_col).csv(f"{path}/top{top_k}")


def write_run(metrics: DataFrame, winner_ranks: DataFrame | None, path: str, run_id: str,
              mode: str = "append") -> None:
    """Metrics as JSON lines and winner ranks as Parquet, both
    partitioned by award and run id (``run_id`` like ``YYYYMMDD_HHMMSS``)."""
    metrics.withColumn("run_id", F.lit(run_id)).write.mode(mode).partitionBy("award", "run_id").json(f"{path}/metrics")
    if winner_ranks is not None:
        (winner_ranks.withColumn("run_id", F.lit(run_id)).write.mode(mode)
         .partitionBy("award", "run_id").parquet(f"{path}/winner_ranks"))


def run_id_now(spark: SparkSession) -> str:
    """A run id from the current timestamp (``YYYYMMDD_HHMMSS``)."""
    return spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]


def prediction_audit(scored: DataFrame, choice: DataFrame, snapshot: str | None, period: int,
                     award_col: str = "award", family_col: str = "family", score_col: str = "score") -> DataFrame:
    """Per award and candidate family its top-1 score, whether it was
    chosen, the snapshot, the period and its season label."""
    from ..functions.scalar import season_label
    tops = scored.groupBy(award_col, family_col).agg(F.max(score_col).alias("top1_score"))
    ch = choice.select(award_col, F.col(family_col).alias("__chosen"))
    return (tops.join(ch, award_col, "left")
            .select(award_col, family_col, "top1_score",
                    (F.col(family_col) == F.col("__chosen")).cast("int").alias("chosen"),
                    F.lit(snapshot).cast("string").alias("snapshot"), F.lit(period).alias("period"),
                    season_label(F.lit(period)).alias("season_label"),
                    F.current_date().alias("built_on")))


def write_snapshots(df: DataFrame, path: str, period_col: str, cutoffs: Sequence[tuple[str, int]],
                    mode: str = "overwrite") -> None:
    """Write ``df`` restricted to ``period <= cutoff`` under ``asof=<date>``
    for each (date, cutoff): the as-of snapshot layout read by S4."""
    first = True
    for day, cut in cutoffs:
        part = df.where(F.col(period_col) <= cut).withColumn("asof", F.lit(day).cast("date"))
        part.write.mode(mode if first else "append").partitionBy("asof").parquet(path)
        first = False


def write_json_record(spark: SparkSession, record: dict, path: str) -> None:
    """A small JSON side record (for example prediction meta)."""
    spark.createDataFrame([(json.dumps(record, default=str),)], "value string").coalesce(1).write.mode(
        "overwrite").text(path)


write_metrics = write_run  # S8 under the survey's other name
