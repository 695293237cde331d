"""Registered queries of sources, sinks and the small builders: each derives a
table from the driver's data, writes it where the operator writes, reads it
back through the library's reader, and is compared with SQL over the original.
Files go to a new scratch folder beside the checkpoints for each run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import shaping as P
from ..operators import windows as W
from ..session import ensure_checkpoint_dir
from ..sources import readers as R
from ..sources import writers as WR
from ..sources.tables import table
from . import datasets as B
from .catalog import FACTS_SQL, GIVEN_SCORES_SQL, UD, _facts, _given_scores, _ud, register, rounded


def _scratch(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


@register("read_facts", """
select event_type, count(*) as n, count(distinct user_id) as users, round(max(value), 6) as max_value
from events group by event_type
""")
def q_s1(spark, sf):
    e = R.read_facts(spark, f"{sf}/events.parquet", ["event_type", "user_id", "value"])
    return rounded(e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"),
                                               F.max("value").alias("max_value")))


@register("read_csv_table", "select c_custkey, c_name, c_nationkey, c_mktsegment from customer")
def q_s2(spark, sf):
    path = f"{_scratch(spark)}/customer"
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    c.write.option("header", True).csv(path)
    return R.read_csv_table(spark, path, c.schema)


@register("read_first_existing", "select s_suppkey, s_name from supplier")
def q_s3(spark, sf):
    return R.read_first_existing(spark, [f"{sf}/no_such_table.parquet", f"{sf}/supplier.parquet"]).select(
        "s_suppkey", "s_name")


@register("read_latest_snapshot", f"""
with {UD} select entity, period, round(mp, 6) as mp, '2024-01-25' as asof from ud where period <= 24
""")
def q_s4(spark, sf):
    path = f"{_scratch(spark)}/snapshots"
    WR.write_snapshots(_ud(spark, sf).select("entity", "period", "mp"), path, "period",
                       [("2024-01-11", 10), ("2024-01-25", 24)])
    newest = R.read_latest_snapshot(spark, path)
    return rounded(newest.withColumn("asof", F.col("asof").cast("string")))


@register("write_run_read_latest", f"""
with {UD}, w as (select period % 5 as award, entity, period, round(mp, 6) as mp from ud where label = 1)
select award, case when award < 2 then '20240101_000000' else '20240201_000000' end as run_id, entity, period, mp from w
""")
def q_s8(spark, sf):
    path = _scratch(spark)
    w = _ud(spark, sf).where("label = 1").select((F.col("period") % 5).cast("long").alias("award"), "entity", "period", "mp")
    metrics = w.groupBy("award").agg(F.count(F.lit(1)).alias("n"))
    WR.write_run(metrics, w, path, "20240101_000000")
    newer = F.col("award") >= 2
    WR.write_run(metrics.where(newer), w.where(newer), path, "20240201_000000")
    out = R.read_latest_run(spark, f"{path}/winner_ranks")
    return rounded(out.select(F.col("award").cast("long").alias("award"), "run_id", "entity", "period", "mp"))


@register("write_award_datasets", f"with {UD} select period as award, entity, round(mp, 6) as mp, label from ud")
def q_s6(spark, sf):
    path = f"{_scratch(spark)}/datasets"
    WR.write_award_datasets(_ud(spark, sf).select(F.col("period").alias("award"), "entity", "mp", "label"), path)
    return rounded(R.read_facts(spark, path).select(F.col("award").cast("int").alias("award"), "entity", "mp", "label"))


@register("write_predictions", f"""
with {GIVEN_SCORES_SQL}, r as (select award, family, entity, score,
  row_number() over (partition by award, family order by score desc, entity) as rank from s)
select award, family, entity, round(score, 6) as score, rank from r where rank <= 3
""")
def q_s7(spark, sf):
    path = _scratch(spark)
    ranked = W.rank_in_period(_given_scores(spark, sf), ["award", "family"], "score", ["entity"])
    WR.write_predictions(ranked, path, top_k=3)
    top = R.read_csv_table(spark, f"{path}/top3", "family string, entity long, score double, rank long, award int")
    return rounded(top.select("award", "family", "entity", "score", "rank"))


@register("drop_columns", "select o_orderkey, o_custkey, round(o_totalprice, 6) as o_totalprice from orders")
def q_p8(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(P.drop_columns(o, [*[c for c in o.columns if c not in ("o_orderkey", "o_custkey", "o_totalprice")],
                                      "no_such_column"]))


@register("row_id_join", f"""
with {FACTS_SQL} select __row_id, round(MP, 6) as MP, round(pct_MP, 6) as pct_MP from facts
""")
def q_j3(spark, sf):
    f = _facts(spark, sf)
    return rounded(J.row_id_join(f.select("__row_id", "MP"), f.select("__row_id", "pct_MP")))


@register("duplicate_keys", """
select o_custkey, o_orderpriority, count(*) as n from orders group by all having count(*) > 1
""")
def q_j2(spark, sf):
    return J.duplicate_keys(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"])


@register("build_clean", """
with e as (select user_id, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as integer) as day, event_id, event_type,
                  row_number() over (partition by user_id, date_diff('day', date '2024-01-01', cast(ts as date)) order by event_id) as rn
           from events)
select user_id, day, event_id from e where rn = 1
""")
def q_b5(spark, sf):
    e = table(spark, sf, "events").select(
        "user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"), "event_id", "event_type")
    clean, _ = B.build_clean(e, ["user_id", "day"], "event_id", drop=["event_type"])
    return clean


@register("build_feature_matrices", f"""
with {FACTS_SQL} select Player, season, round(pct_G, 6) as pct_G, round(pct_MP, 6) as pct_MP from facts
""")
def q_b6(spark, sf):
    f = _facts(spark, sf)
    era, _ = B.build_feature_matrices(f, ["pct_G", "pct_MP", "is_rookie", "no_such"], keep=["Player", "season"])
    return rounded(era)
