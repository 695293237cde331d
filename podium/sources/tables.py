"""The driver's tables and the entity-period fact tables Spark derives from
them (FIXTURES.md part C).

* ``user_day``  -- events -> one row per (user, day): 30 periods.
* ``cust_year`` -- orders x customer x nation -> one row per (customer, year).
* ``doc_label`` -- documents x labels -> one row per labelled document.

Each is a lazy plan over the Parquet files: the scan reads only the columns
named here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import join_summary
from ..operators.windows import entity_window
from .readers import read_facts

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

EPOCH = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str, where: Sequence[tuple] = ()) -> DataFrame:
    return read_facts(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", where=where)


def _winner_flag(df: DataFrame, period_col: str, score_col: str, entity_col: str,
                 out_col: str = "label") -> DataFrame:
    """1 for the row with the highest score in its period (lowest entity on
    ties), else 0.  The best row per period comes from a partial aggregation
    (``min`` of an ordered struct), not from a window over the whole period."""
    best = (df.where(F.col(score_col).isNotNull()).groupBy(F.col(period_col).alias("__bp"))
            .agg(F.min(F.struct((-F.col(score_col)).alias("s"), F.col(entity_col).alias("e"))).alias("__b")))
    j = join_summary(df, best, [(period_col, "__bp")])
    flag = ((F.col(entity_col) == F.col("__b.e")) & (-F.col(score_col) == F.col("__b.s"))).cast("int")
    return j.select(*[F.col(c) for c in df.columns], F.coalesce(flag, F.lit(0)).alias(out_col))


def _first_period_flag(df: DataFrame, entity_col: str, period_col: str, out_col: str = "is_rookie") -> DataFrame:
    # one row per entity and period: a window over an entity holds as many rows as there are periods
    first = F.min(period_col).over(entity_window(df, entity_col))
    return df.withColumn(out_col, (F.col(period_col) == first).cast("int"))


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    agg = (ev.groupBy(F.col("user_id").alias("entity"),
                      F.datediff(F.to_date("ts"), F.lit(EPOCH).cast("date")).alias("period"))
           .agg(F.count(F.lit(1)).alias("g"),
                F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).cast("long").alias("gs"),
                F.round(F.sum("value"), 6).alias("mp"),
                F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(F.lit(0.0))), 6)
                .alias("pts")))
    return _first_period_flag(_winner_flag(agg, "period", "pts", "entity"), "entity", "period")


USER_DAY_SQL = """
with base as (
  select user_id as entity,
         cast(date_diff('day', date '2024-01-01', cast(ts as date)) as integer) as period,
         count(*) as g,
         cast(sum(case when event_type = 'view' then 1 else 0 end) as bigint) as gs,
         round(sum(value), 6) as mp,
         round(sum(case when event_type = 'purchase' then value else 0.0 end), 6) as pts
  from events group by 1, 2)
select *,
  cast(row_number() over (partition by period order by pts desc, entity) = 1 as integer) as label,
  cast(period = min(period) over (partition by entity) as integer) as is_rookie
from base
"""


def cust_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    agg = (o.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("period"))
           .agg(F.count(F.lit(1)).alias("g"),
                F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).cast("long").alias("gs"),
                F.round(F.sum("o_totalprice"), 6).alias("mp")))
    dims = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select(
        F.col("c_custkey"), F.col("c_mktsegment").alias("Pos"), F.col("n_name").alias("Tm"))
    j = agg.join(dims, agg["entity"] == dims["c_custkey"], "left").drop("c_custkey")
    return _first_period_flag(_winner_flag(j, "period", "mp", "entity"), "entity", "period")


CUST_YEAR_SQL = """
with base as (
  select o_custkey as entity, cast(year(o_orderdate) as integer) as period,
         count(*) as g,
         cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as gs,
         round(sum(o_totalprice), 6) as mp
  from orders group by 1, 2),
j as (
  select b.*, c.c_mktsegment as Pos, n.n_name as Tm
  from base b left join customer c on b.entity = c.c_custkey
              left join nation n on c.c_nationkey = n.n_nationkey)
select *,
  cast(row_number() over (partition by period order by mp desc, entity) = 1 as integer) as label,
  cast(period = min(period) over (partition by entity) as integer) as is_rookie
from j
"""


def doc_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    words = F.size(F.split(F.trim(F.col("text")), r"\s+"))
    # digits = characters removed by deleting 0-9 (a translate, cheaper than a regex)
    digits = F.length(F.col("text")) - F.length(F.translate(F.col("text"), "0123456789", ""))
    # the text features are computed where the text is read, so the join
    # moves a few numbers per document instead of whole texts
    feats = d.select(
        "doc_id", "lang",
        F.col("n_chars").cast("double").alias("n_chars"),
        words.cast("double").alias("n_words"),
        F.try_divide(digits.cast("double"), F.nullif(F.length("text"), F.lit(0)).cast("double")).alias("digit_share"))
    j = feats.join(lab, "doc_id", "inner")
    return j.select("doc_id", "lang", "n_chars", "n_words", "digit_share",
                    F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))


DOC_LABEL_SQL = """
select d.doc_id, d.lang, cast(d.n_chars as double) as n_chars,
       cast(len(string_split_regex(trim(d.text), '\\s+')) as double) as n_words,
       cast(length(regexp_replace(d.text, '[^0-9]', '', 'g')) as double) / nullif(length(d.text), 0) as digit_share,
       cast(l.quality as integer) as quality, cast(l.toxic as integer) as toxic
from documents d join labels l on d.doc_id = l.doc_id
"""
