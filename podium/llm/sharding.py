"""Contiguous shards of near-equal byte size (operator 1, native).

The rows' keys and sizes (never the texts) are range-partitioned into blocks
and written with their block number.  One total per block gives the global
prefix sums: a row's place on the byte axis is its block's offset plus the
running sum inside its block.  The axis is cut at equal targets, so shards are
contiguous in key order and each differs from the target by at most one row at
either end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ROWS_PER_BLOCK = 100_000


def contiguous_shards(df: DataFrame, n_shards: int, size: Column, key: str,
                      carry: dict[str, Column] | None = None,
                      rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(key, size, *carry, shard int, slot long) for every row of ``df``.

    ``size`` must be a non-negative long.  Shard ``s`` holds the rows whose
    middle byte lies in the ``s``-th of ``n_shards`` equal cuts of the total;
    ``slot`` counts from 0 within the shard in key order.  Null keys sort
    first; rows with equal keys are ordered by size and then by the carried
    columns, so equal rows may swap places but nothing else changes.  A
    null size counts 0.  If all sizes are 0, all rows go to shard 0.  An empty
    table gives no rows.  Other columns of ``df`` are ignored, whatever their
    names.
    """
    carry = carry or {}
    spark = df.sparkSession
    rows = df.select(F.struct(F.col(key).alias("k"), F.coalesce(size, F.lit(0)).cast("long").alias("size"),
                              *[c.alias(f"c{i}") for i, c in enumerate(carry.values())]).alias("o"))
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(least, math.ceil(df.count() / rows_per_block))
    blocks = materialize(rows.repartitionByRange(n_blocks, "o").select("o", F.spark_partition_id().alias("block")),
                         "blocks")

    # one row per block: the only window without a partition key
    by_block = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("o.size").alias("bytes"))
    offsets = totals.select(
        F.col("block").alias("b"),
        F.coalesce(F.sum("n").over(by_block), F.lit(0)).alias("rows0"),
        F.coalesce(F.sum("bytes").over(by_block), F.lit(0)).alias("bytes0"),
        F.sum("bytes").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding,
                                                               Window.unboundedFollowing)).alias("total"))
    inside = Window.partitionBy("block").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    placed = (blocks.withColumn("before", F.coalesce(F.sum("o.size").over(inside), F.lit(0)))
              .withColumn("nth", F.row_number().over(Window.partitionBy("block").orderBy("o")) - 1)
              .join(offsets, F.col("block") == F.col("b")))
    cut = f"((2 * (bytes0 + before) + o.size) * {n_shards}) div (2 * nullif(total, 0))"
    placed = placed.select("o", (F.col("rows0") + F.col("nth")).alias("at"),
                           F.expr(f"cast(coalesce({cut}, 0) as int)").alias("shard"))
    placed = materialize(placed, "placed")
    # at most n_shards rows
    first = F.broadcast(placed.groupBy(F.col("shard").alias("s")).agg(F.min("at").alias("at0")))
    return placed.join(first, F.col("shard") == F.col("s")).select(
        F.col("o.k").alias(key), F.col("o.size").alias("size"),
        *[F.col(f"o.c{i}").alias(name) for i, name in enumerate(carry)],
        "shard", (F.col("at") - F.col("at0")).alias("slot"))
