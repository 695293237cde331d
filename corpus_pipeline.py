"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark
decontamination and best-fit packing over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of ``docs``; the last returns the packing.  ``run``
writes each stage's result as Parquet in the shared folder and rereads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podium.llm import decontaminate, line_dedup, packing, quality, simhash
from podium.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio; the target
    is the documents labelled as good."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.quality_verdicts(docs, trusted).where("kept").select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its source's boilerplate lines; n_chars follows.
    Null texts stay as they are.  Copies are still there and count as one page, or
    they would lose their text as boilerplate before the next stage can keep one."""
    cut = line_dedup.drop_boilerplate(docs, copies_once=True)
    new = {"text": F.col("text"),
           "n_chars": F.coalesce(F.length("text").cast("long"), F.col("row.n_chars"))}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of smallest doc_id (null:
    largest), of its rows one with the smallest text hash."""
    found = simhash.near_duplicates(docs)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")).alias("b"))
    best = best.select(F.col("b.doc_id").alias("id"), F.col("b.th").alias("h"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("d"),
                       simhash.text_hash(F.col("text")).alias("t"))
    kept = rows.join(best, F.col("d").eqNullSafe(F.col("id")) & (F.col("t") == F.col("h")), "left_semi")
    # rows repeated in full: one of them
    one = Window.partitionBy("d", "t").orderBy("d", "t")
    return kept.withColumn("nth", F.row_number().over(one)).where("nth = 1").select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in bins of fixed length."""
    return packing.best_fit(docs, packing.word_length())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Hashed n-gram ratios and SimHash can't be expressed in SQL; tests/llm holds
#: the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
