"""Order statistics that never put a whole group into one task.

A window ``partition by period order by score`` sends every row of a period to
one task; at scale a period (or a whole table, for a global AUC) is unbounded.
One algorithm serves every size:

1. The rows are range-partitioned by (group, order) with Spark's own
   ``repartitionByRange`` and written once, with the number of their partition,
   their *block*.  Since the number is on disk, every later read agrees on it,
   whatever was retried or planned anew.  A large group spans many blocks and
   small ones share a block.
2. A window over (block, group) gives running sums inside the block.
3. Only a group that spans blocks needs more: one row per block of it gives each
   block's offset and the group's total -- at most two rows per block, joined back.

Tables go to the shared folder (``spark.checkpoint.dir``), so they survive lost
executors.  There are at least ``spark.sql.shuffle.partitions`` blocks; a table
whose blocks would hold more than ``ROWS_PER_BLOCK`` rows is dealt again into as many
as it takes.  Results do not depend on the number.  Rows travel inside one
struct, so the caller's column names never clash with ours.  Everything stays in
native operators: no Python per row.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import col_ref
from ..session import ensure_checkpoint_dir

_ALL = "__all"
#: rows of a block on average, at most
ROWS_PER_BLOCK = 1_000_000
#: session setting that fixes the number of blocks
BLOCKS_CONF = "podium.ordering.blocks"
#: copies of a group summary, so that joining it back splits a large group
SALTS = 16


def _as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def fresh(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores before it until no table has such a column."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_summary(df: DataFrame, summary: DataFrame, on: Sequence[tuple[str, str]], how: str = "left",
                 salts: int = SALTS) -> DataFrame:
    """``df`` joined with a small table of one row per group, null-safe on the pairs
    (column of df, column of summary).  Small summaries are broadcast by Spark; else
    the summary is repeated ``salts`` times and the rows of a group are spread by
    their hash, so no task gets a whole group.  Summary columns must have names of
    their own."""
    mine, theirs = fresh("__spread", df, summary), fresh("__salt", df, summary)
    spread = F.pmod(F.xxhash64(*[col_ref(c) for c in df.columns]), F.lit(salts)).cast("int")
    copies = summary.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = df.withColumn(mine, spread)
    cond = [col_ref(a).eqNullSafe(col_ref(b)) for a, b in on] + [F.col(mine) == F.col(theirs)]
    return left.join(copies, all_of(cond), how).drop(mine, theirs)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/podium-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once with a unique number for every row in a column ``name``."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def in_blocks(rows: DataFrame, order: Sequence[Column], blocks: int | None = None) -> DataFrame:
    """``rows`` written with a column ``b``: the range partition, in ``order``, that holds them."""
    conf = rows.sparkSession.conf
    fixed = blocks or conf.get(BLOCKS_CONF, None)
    n = int(fixed or conf.get("spark.sql.shuffle.partitions", "200"))

    def deal(t: DataFrame, parts: int) -> DataFrame:
        return written(t.repartitionByRange(parts, *order).withColumn("b", F.spark_partition_id()), "blocks")

    dealt = deal(rows, n)
    if not fixed:
        need = math.ceil(dealt.count() / ROWS_PER_BLOCK)  # from the files' footers
        if need > n:
            dealt = deal(dealt.drop("b"), need)
    return dealt


def _packed(df: DataFrame, group_cols: Sequence[str]) -> tuple[DataFrame, list[str], Sequence[int]]:
    """Rows as structs ``row`` (c0, c1, ...) and ``g`` (the group), the columns, and the
    places of those that Parquet can't hold (untyped nulls; they stay out of the struct)."""
    cols = df.columns
    void = [i for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.NullType)]
    kept = [col_ref(c).alias(f"c{i}") for i, c in enumerate(cols) if i not in void]
    group = F.struct(F.lit(0).alias("g"), *[col_ref(c).alias(f"g{i}") for i, c in enumerate(group_cols)])
    return df.select(F.struct(F.lit(0).alias("c"), *kept).alias("row"), group.alias("g")), cols, void


def _unpacked(cols: Sequence[str], void: Sequence[int]) -> list[Column]:
    return [(F.lit(None) if i in void else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(cols)]


def running_totals(df: DataFrame, group_cols: Sequence[str], order_by: Sequence[tuple[str, bool]],
                   sums: Sequence[str], *, prefix: str = "cum_", totals: str | None = None,
                   blocks: int | None = None) -> DataFrame:
    """Add inclusive running sums ``{prefix}{c}`` of ``sums`` within each group, in the
    order ``order_by``: (column, ascending), any orderable type; nulls come first in
    ascending order and last in descending.  ``totals`` adds the group's sums under
    that prefix.

    ``group_cols + order_by`` must identify a row uniquely (end the ordering with a
    unique key), otherwise the split between tied rows is arbitrary.
    """
    sums = _as_list(sums)
    rows, cols, void = _packed(df, _as_list(group_cols))

    def field(c: str) -> Column:
        return F.col(f"row.c{cols.index(c)}")

    order = [field(c).asc_nulls_first() if asc else field(c).desc_nulls_last() for c, asc in order_by]
    blocked = in_blocks(rows, [F.col("g").asc(), *order], blocks)

    whole = Window.partitionBy("b", "g")
    inside = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = blocked.select("row", "g", "b", *[F.sum(field(c)).over(inside).alias(f"l{i}") for i, c in enumerate(sums)],
                           *[F.sum(field(c)).over(whole).alias(f"w{i}") for i, c in enumerate(sums) if totals is not None])
    per_block = blocked.groupBy("b", "g").agg(*[F.sum(field(c)).alias(f"t{i}") for i, c in enumerate(sums)])
    group = Window.partitionBy("g")
    before = group.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    # one row per block of a group that spans blocks
    edges = per_block.select(
        F.col("g").alias("og"), F.col("b").alias("ob"), F.count(F.lit(1)).over(group).alias("k"),
        *[F.coalesce(F.sum(f"t{i}").over(before), F.lit(0)).alias(f"f{i}") for i in range(len(sums))],
        *[F.sum(f"t{i}").over(group).alias(f"a{i}") for i in range(len(sums))]).where("k > 1")
    both = local.join(edges, (F.col("g") == F.col("og")) & (F.col("b") == F.col("ob")), "left")
    return both.select(
        *_unpacked(cols, void),
        *[(F.col(f"l{i}") + F.coalesce(F.col(f"f{i}"), F.lit(0))).alias(f"{prefix}{c}") for i, c in enumerate(sums)],
        *[F.coalesce(f"a{i}", f"w{i}").alias(f"{totals}{c}") for i, c in enumerate(sums) if totals is not None])


def average_ranks(df: DataFrame, group_cols: Sequence[str], value: Column, *, before: str = "_before",
                  through: str = "_through", total: str = "_total", blocks: int | None = None) -> DataFrame:
    """Every row whose ``value`` is not null, with the number of rows of its group with a
    smaller value, with a smaller or equal one, and in all.  Its average rank is
    ``(before + 1 + through) / 2``.

    The rows carry their ranks through the blocks themselves: no join on values.
    Rows are dealt by (group, value, their hash), so equal values may fill many
    blocks; a run of equal values that goes on beyond its block is mended from one
    row per block.  Fully equal rows share a block.
    """
    packed, cols, void = _packed(df.withColumn(fresh("__value", df), value), _as_list(group_cols))
    cols = cols[:-1]
    rows = packed.select("row", "g", F.col(f"row.c{len(cols)}").alias("v")).where("v is not null")
    blocked = in_blocks(rows, [F.col("g").asc(), F.col("v").asc(), F.xxhash64("row").asc()], blocks)

    whole = Window.partitionBy("b", "g")
    by_value = whole.orderBy("v")
    local = blocked.select("row", "g", "b", "v", (F.rank().over(by_value) - 1).cast("long").alias("lb"),
                           F.count(F.lit(1)).over(by_value).alias("lt"), F.count(F.lit(1)).over(whole).alias("n"))
    # the block's rows of the group, its first and last value, the ties of the first, the rows before the last:
    # the rows of these two values have them all
    ends = local.where("lb = 0 or lt = n").groupBy("b", "g").agg(F.max("n").alias("n"), F.min("v").alias("vf"), F.max("v").alias("vl"),
                                       F.min("lt").alias("nf"), F.max("lb").alias("nl"))
    group = Window.partitionBy("g")
    in_order = group.orderBy("b")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    later = in_order.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select("*", F.count(F.lit(1)).over(group).alias("k"), F.sum("n").over(group).alias("all"),
                       F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("off"),
                       (F.lag("vl").over(in_order) == F.col("vf")).alias("joins"),
                       (F.lead("vf").over(in_order) == F.col("vl")).alias("goes_on")).where("k > 1")
    one = F.col("vf") == F.col("vl")
    # where the run of the last value starts and that of the first ends; null: in another block
    ends = ends.withColumn("start", F.when(~(one & F.coalesce("joins", F.lit(False))), F.col("off") + F.col("nl")))
    ends = ends.withColumn("end", F.when(~(one & F.coalesce("goes_on", F.lit(False))), F.col("off") + F.col("nf")))
    edges = ends.select(
        F.col("g").alias("og"), F.col("b").alias("ob"), "vf", "vl", "off", "all",
        F.when(F.col("joins"), F.last("start", ignorenulls=True).over(earlier)).alias("first_before"),
        F.when(F.col("goes_on"), F.first("end", ignorenulls=True).over(later)).alias("last_through"))
    both = local.join(edges, (F.col("g") == F.col("og")) & (F.col("b") == F.col("ob")), "left")
    off = F.coalesce("off", F.lit(0))
    low = F.when((F.col("v") == F.col("vf")) & F.col("first_before").isNotNull(), F.col("first_before")).otherwise(off + F.col("lb"))
    high = F.when((F.col("v") == F.col("vl")) & F.col("last_through").isNotNull(), F.col("last_through")).otherwise(off + F.col("lt"))
    return both.select(*_unpacked(cols, void), low.alias(before), high.alias(through),
                       F.coalesce("all", "n").alias(total))


def value_positions(df: DataFrame, group_cols: Sequence[str], value_col: str,
                    weights: dict[str, Column] | None = None, *, descending: bool = False,
                    blocks: int | None = None) -> DataFrame:
    """Distinct non-null values per group with their multiplicity ``_n``, the
    number of values strictly before them ``_before``, their average rank
    ``_avg_rank`` (1-based, ties averaged) in ascending (or descending) order, and
    the group's non-null count ``_total``.

    Duplicated values are folded by a partial aggregation first, so a value
    that holds a third of all rows becomes one row before any shuffle.
    Extra ``weights`` (name -> column) are summed per value and get running
    totals ``cum_<name>`` as well.
    """
    groups, weights = _as_list(group_cols), weights or {}
    folded = (df.where(col_ref(value_col).isNotNull()).groupBy(*[col_ref(g) for g in groups], col_ref(value_col))
              .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(e).alias(k) for k, e in weights.items()]))
    rt = running_totals(folded, groups, [(value_col, not descending)], ["_n", *weights], totals="all_", blocks=blocks)
    return (rt.withColumn("_before", F.col("cum__n") - F.col("_n"))
            .withColumn("_avg_rank", F.col("_before").cast("double") + (F.col("_n").cast("double") + 1.0) / 2.0)
            .withColumnRenamed("all__n", "_total").drop(*[f"all_{k}" for k in weights]))


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                    probs: Sequence[float], names: Sequence[str] | None = None, *,
                    blocks: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (Spark ``percentile``, DuckDB
    ``quantile_cont``) per group, one row per group with columns ``names`` (default
    ``q0, q1 ...``) and ``n`` (non-null count).  Groups with no non-null value are
    absent.

    A distinct value covers the order positions from ``_before`` up to its
    running count; the values that cover a quantile's two positions are picked by
    one partial aggregation.
    """
    groups = _as_list(group_cols)
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    pos = value_positions(df.select(*[col_ref(g) for g in groups], col_ref(value_col)), groups, value_col, blocks=blocks)

    def place(p: float, total: Column) -> Column:
        return (total - 1).cast("double") * float(p)

    def covering(end) -> Column:
        at = end.cast("long")
        return F.max(F.when((F.col("_before") <= at) & (at < F.col("cum__n")), col_ref(value_col).cast("double")))

    ends = []
    for i, p in enumerate(probs):
        h = place(p, F.col("_total"))
        ends += [covering(F.floor(h)).alias(f"__lo{i}"), covering(F.ceil(h)).alias(f"__hi{i}")]
    aggs = [F.max("_total").alias("__n"), *ends]
    one = pos.groupBy(*[col_ref(g) for g in groups]).agg(*aggs) if groups else pos.agg(*aggs).where("__n is not null")
    out = []
    for i, (p, name) in enumerate(zip(probs, names)):
        h = place(p, F.col("__n"))
        out.append((F.col(f"__lo{i}") + (h - F.floor(h)) * (F.col(f"__hi{i}") - F.col(f"__lo{i}"))).alias(name))
    return one.select(*[col_ref(g) for g in groups], *out, F.col("__n").alias("n"))


def row_positions(df: DataFrame, group_cols: Sequence[str], order_by: Sequence[tuple[str, bool]],
                  out_col: str = "rank", *, blocks: int | None = None) -> DataFrame:
    """1-based position of every row inside its group (``row_number``), for a
    row-unique ordering; scales like :func:`running_totals`."""
    one = fresh("__one", df)
    ones = df.withColumn(one, F.lit(1).cast("long"))
    rt = running_totals(ones, group_cols, order_by, [one], prefix=fresh("__cum", df), blocks=blocks)
    return rt.withColumnRenamed(rt.columns[-1], out_col).drop(one)
