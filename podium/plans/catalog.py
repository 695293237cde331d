"""Registered queries over the driver's tables, each with its DuckDB oracle.

Every query reads the given Parquet tables (or tables Spark derives from
them: ``user_day``, ``cust_year``, ``doc_label``) in full and runs one
operator family; doubles are rounded to 6 decimals on both sides (T10).
Thresholds that the reference sets for basketball minutes do not fit these
tables, so queries pass their own (stated beside each query).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggregate as G
from ..operators import eligibility as E
from ..operators import joins as J
from ..operators import leakage as L
from ..operators import metrics as M
from ..operators import shaping as P
from ..operators import topk as K
from ..operators import windows as W
from ..functions import scalar as S
from ..sources.tables import (CUST_YEAR_SQL, DOC_LABEL_SQL, USER_DAY_SQL, cust_year, doc_label,
                              table, user_day)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, nd: int = 6) -> DataFrame:
    """Round every double column."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), nd).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def _ud(spark, sf):
    return user_day(spark, sf)


UD = f"ud as ({USER_DAY_SQL})"
CY = f"cy as ({CUST_YEAR_SQL})"
DL = f"dl as ({DOC_LABEL_SQL})"
# user_day seen with the reference's column names (G games, GS starts, MP minutes)
UDN = f"{UD}, udn as (select entity as Player, period as season, g as G, gs as GS, mp as MP, pts as PTS, label, is_rookie from ud)"


def _udn(spark, sf):
    return _ud(spark, sf).select(F.col("entity").alias("Player"), F.col("period").alias("season"),
                                 F.col("g").alias("G"), F.col("gs").alias("GS"), F.col("mp").alias("MP"),
                                 F.col("pts").alias("PTS"), "label", "is_rookie")


PCT_SQL = ("(rank() over (partition by {p} order by {c}) + cast(count(*) over (partition by {p}, {c}) - 1 as double) / 2)"
           " / count({c}) over (partition by {p})")


def pct_sql(c, p="period"):
    return f"case when {c} is null then null else {PCT_SQL.format(c=c, p=p)} end"


# ---------------------------------------------------------------------------
# Flagship: user_day -> prev features (W1) -> per-period percentile (W4) as
# score -> winner ranks (W3/M1) -> ranking report (M1)
# ---------------------------------------------------------------------------
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    ud = W.add_prev_features(_ud(spark, sf), "entity", "period", ["mp"])
    scored = W.percent_rank_avg(ud, "period", "mp")
    return rounded(M.ranking_report(scored, "period", "mp_pct", "label", ["entity"]))


FLAGSHIP_SQL = f"""
with {UD},
x as (select period, entity, label, {pct_sql('mp')} as s from ud),
r as (select period, label, row_number() over (partition by period order by s desc, entity) as rk
      from x where s is not null),
w as (select period, min(rk) as winner_rank from r where label = 1 group by period)
select round(coalesce(avg(case when winner_rank <= 1 then 1.0 else 0.0 end), 0), 6) as hit_at_1,
       round(coalesce(avg(case when winner_rank <= 5 then 1.0 else 0.0 end), 0), 6) as hit_at_5,
       round(coalesce(avg(1.0 / winner_rank), 0), 6) as mrr,
       round(avg(cast(winner_rank as double)), 6) as mean_winner_rank,
       count(winner_rank) as n_periods
from w
"""
register("ranking_report_user_day", FLAGSHIP_SQL)(flagship)


@register("ranking_report_cust_year", f"""
with {CY},
x as (select period, entity, label, {pct_sql('g')} as s from cy),
r as (select period, label, row_number() over (partition by period order by s desc, entity) as rk
      from x where s is not null),
w as (select period, min(rk) as winner_rank from r where label = 1 group by period)
select round(coalesce(avg(case when winner_rank <= 1 then 1.0 else 0.0 end), 0), 6) as hit_at_1,
       round(coalesce(avg(case when winner_rank <= 5 then 1.0 else 0.0 end), 0), 6) as hit_at_5,
       round(coalesce(avg(1.0 / winner_rank), 0), 6) as mrr,
       round(avg(cast(winner_rank as double)), 6) as mean_winner_rank,
       count(winner_rank) as n_periods
from w
""")
def q_rr_cust(spark, sf):
    # order count percentile as the score: many ties, broken by entity
    scored = W.percent_rank_avg(cust_year(spark, sf), "period", "g")
    return rounded(M.ranking_report(scored, "period", "g_pct", "label", ["entity"]))


# ---------------------------------------------------------------------------
# Windows
# ---------------------------------------------------------------------------
@register("prev_features", f"""
with {UD}
select entity, period,
  lag(g) over w as prev_g, lag(mp) over w as prev_mp, lag(pts) over w as prev_pts
from ud window w as (partition by entity order by period)
""")
def q_prev(spark, sf):
    out = W.add_prev_features(_ud(spark, sf), "entity", "period", ["g", "mp", "pts"])
    return rounded(out.select("entity", "period", "prev_g", "prev_mp", "prev_pts"))


@register("delta_features", f"""
with {UD}, p as (
  select entity, period, g, mp, lag(g) over w as prev_g, lag(mp) over w as prev_mp
  from ud window w as (partition by entity order by period))
select entity, period, round(cast(g as double) - prev_g, 6) as delta_g, round(mp - prev_mp, 6) as delta_mp from p
""")
def q_delta(spark, sf):
    out = W.add_delta_features(W.add_prev_features(_ud(spark, sf), "entity", "period", ["g", "mp"]), ["g", "mp"])
    return rounded(out.select("entity", "period", "delta_g", "delta_mp"))


@register("rank_in_period", f"""
with {UD}
select entity, period, row_number() over (partition by period order by mp desc, entity) as rank from ud
""")
def q_rank(spark, sf):
    return W.rank_in_period(_ud(spark, sf), "period", "mp", ["entity"]).select("entity", "period", "rank")


@register("percent_rank_avg", f"""
with {UD}
select entity, period, round({pct_sql('mp')}, 6) as mp_pct, round({pct_sql('g')}, 6) as g_pct,
       round({pct_sql('gs')}, 6) as gs_pct from ud
""")
def q_pct(spark, sf):
    out = W.percent_rank_avg(_ud(spark, sf), "period", ["mp", "g", "gs"])
    return rounded(out.select("entity", "period", "mp_pct", "g_pct", "gs_pct"))


@register("volume_features", f"""
with {UDN}
select Player, season,
  round({pct_sql('G', 'season')}, 6) as G_vol_pct, round({pct_sql('GS', 'season')}, 6) as GS_vol_pct,
  round({pct_sql('MP', 'season')}, 6) as MP_vol_pct,
  cast(coalesce({pct_sql('MP', 'season')} < 0.10, false) as integer) as low_volume_flag
from udn
""")
def q_volume(spark, sf):
    out = W.add_volume_features(_udn(spark, sf), "season", "mvp")
    return rounded(out.select("Player", "season", "G_vol_pct", "GS_vol_pct", "MP_vol_pct", "low_volume_flag"))


@register("best_per_group", f"""
with {UD}, r as (select period, entity, mp, row_number() over (partition by period order by mp desc nulls last, entity) as rn from ud)
select period, entity, mp from r where rn = 1
""")
def q_best(spark, sf):
    ud = _ud(spark, sf).select("period", "entity", "mp")
    return rounded(W.best_per_group(ud, ["period"], "mp", ["entity"]))


@register("temporal_split_last_k", f"""
with {UD}, d as (select distinct period from ud),
r as (select period, dense_rank() over (order by period desc) as r from d)
select ud.entity, ud.period,
  case when r.r <= 3 then 'test' when r.r <= 6 then 'val' else 'train' end as split
from ud join r on ud.period = r.period
""")
def q_split_k(spark, sf):
    return W.temporal_split_last_k(_ud(spark, sf), "period", 3, 3).select("entity", "period", "split")


@register("temporal_split_cutoff", f"""
with {CY}
select split, count(*) as n_rows, count(distinct period) as n_periods,
       cast(sum(label) as bigint) as n_pos
from (select *, case when period <= 1996 then 'train' when period <= 1998 then 'val' else 'test' end as split from cy) t
group by split
""")
def q_split_cut(spark, sf):
    # cut-offs fitted to the order years: train <= 1996 < val <= 1998 < test
    s = W.temporal_split_cutoff(cust_year(spark, sf), "period", 1996, 1998)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("period").alias("n_periods"),
                                  F.sum("label").cast("long").alias("n_pos"))


@register("walk_forward_folds", f"""
with {UD}, per as (select period, count(*) as n_rows, cast(sum(label) as bigint) as n_pos from ud group by period),
pairs as (select f.period as fold, p.period, case when p.period = f.period then 'test' else 'train' end as role,
                 p.n_rows, p.n_pos
          from per f join per p on p.period <= f.period),
ok as (select fold from pairs where role = 'train' group by fold having sum(n_pos) > 0)
select fold, period, role, n_rows, n_pos from pairs where fold in (select fold from ok)
""")
def q_wf(spark, sf):
    return W.walk_forward_folds(_ud(spark, sf), "period", "label")


@register("learning_curve_folds", f"""
with {UD}, per as (select period, count(*) as r, cast(sum(label) as bigint) as p from ud group by period),
idx as (select *, row_number() over (order by period) as i, count(*) over () as n from per),
fr as (select unnest([0.2, 0.4, 0.6, 0.8, 1.0]) as frac),
pairs as (select fr.frac, idx.* from fr join idx on idx.i <= ceil(fr.frac * idx.n)),
a as (select frac, count(*) as n_periods, max(period) as periods_max, cast(sum(r) as bigint) as n_train_rows,
             cast(sum(p) as bigint) as n_pos from pairs group by frac)
select cast(frac as double) as frac, n_periods, periods_max, n_train_rows, n_pos, n_train_rows - n_pos as n_neg,
  case when n_periods < 3 then 'too_few_periods' when n_pos = 0 or n_train_rows - n_pos = 0 then 'single_class'
       when n_pos < 1 then 'too_few_positives' else 'ok' end as status
from a
""")
def q_lc(spark, sf):
    return rounded(W.learning_curve_folds(_ud(spark, sf), "period", "label"))


@register("group_zscore", f"""
with {UD}
select entity, period,
  round((mp - avg(mp) over w) / nullif(stddev_samp(mp) over w, 0), 6) as mp_z,
  round((g - avg(g) over w) / nullif(stddev_samp(g) over w, 0), 6) as g_z
from ud window w as (partition by period)
""")
def q_z(spark, sf):
    return rounded(W.group_zscore(_ud(spark, sf), "period", ["mp", "g"]).select("entity", "period", "mp_z", "g_z"))


# ---------------------------------------------------------------------------
# Top-k and result tables
# ---------------------------------------------------------------------------
@register("top_k_per_period", f"""
with {UD}, r as (select entity, period, pts, row_number() over (partition by period order by pts desc, entity) as rank from ud)
select entity, period, pts, rank from r where rank <= 3
""")
def q_topk(spark, sf):
    return rounded(W.top_k_per_period(_ud(spark, sf), "period", "pts", ["entity"], 3).select("entity", "period", "pts", "rank"))


@register("top_k_global", f"""
with {UD} select entity, period, mp from ud order by mp desc, entity, period limit 10
""")
def q_topg(spark, sf):
    return rounded(K.top_k_global(_ud(spark, sf).select("entity", "period", "mp"), "mp", 10, ["entity", "period"]))


WINNER_RANKS_SQL = f"""
{UD}, x as (select period, entity, label, {pct_sql('mp')} as s from ud),
r as (select period, entity, label, s, row_number() over (partition by period order by s desc, entity) as rank
      from x where s is not null)
"""


def _winner_table(spark, sf):
    scored = W.percent_rank_avg(_ud(spark, sf), "period", "mp")
    return M.winner_rank_table(scored, "period", "mp_pct", "label", ["entity"], keep=["entity"])


@register("winner_rank_table", f"""
with {WINNER_RANKS_SQL}
select period, entity, round(s, 6) as mp_pct, rank from r where label = 1
""")
def q_wrt(spark, sf):
    return rounded(_winner_table(spark, sf))


@register("worst_periods", f"""
with {WINNER_RANKS_SQL}
select period, rank from r where label = 1 order by rank desc, period
""")
def q_worst(spark, sf):
    return K.worst_periods(_winner_table(spark, sf).select("period", "rank"), "period", "rank")


@register("worst_period", f"""
with {WINNER_RANKS_SQL}
select period, rank from r where label = 1 order by rank desc, period limit 1
""")
def q_worst1(spark, sf):
    return K.worst_period(_winner_table(spark, sf).select("period", "rank"), "period", "rank")


@register("winner_rank_summary", f"""
with {WINNER_RANKS_SQL}, w as (select period, rank from r where label = 1)
select count(distinct period) as seasons,
  round(avg(case when rank <= 1 then 1.0 else 0.0 end), 6) as top1, round(avg(case when rank <= 3 then 1.0 else 0.0 end), 6) as top3,
  round(avg(case when rank <= 5 then 1.0 else 0.0 end), 6) as top5, round(avg(case when rank <= 10 then 1.0 else 0.0 end), 6) as top10,
  round(avg(1.0 / rank), 6) as mrr, round(median(cast(rank as double)), 6) as median_rank, cast(max(rank) as double) as max_rank
from w
""")
def q_wrs(spark, sf):
    return rounded(M.winner_rank_summary(_winner_table(spark, sf), "rank", period_col="period"))


@register("topk_accuracy", f"""
with {WINNER_RANKS_SQL}, w as (select rank from r where label = 1)
select round(avg(case when rank <= 1 then 1.0 else 0.0 end), 6) as top1, round(avg(case when rank <= 3 then 1.0 else 0.0 end), 6) as top3,
  round(avg(case when rank <= 5 then 1.0 else 0.0 end), 6) as top5, round(avg(case when rank <= 10 then 1.0 else 0.0 end), 6) as top10,
  round(avg(1.0 / rank), 6) as mrr, count(*) as n_winners
from w
""")
def q_topacc(spark, sf):
    scored = W.percent_rank_avg(_ud(spark, sf), "period", "mp")
    return rounded(M.topk_accuracy(scored, "period", "mp_pct", "label", ["entity"]))


AUC_SQL = """
s as (select {score} as s, cast({label} as integer) as y from {src} where {score} is not null),
v as (select s, sum(y) as pos, count(*) - sum(y) as neg, count(*) as n from s group by s),
rk as (select *, sum(n) over (order by s rows between unbounded preceding and current row) - n as before from v),
a as (select sum(pos * (before + (n + 1) / 2.0)) as rsum, cast(sum(pos) as double) as P, cast(sum(neg) as double) as N from rk)
"""


@register("roc_auc_doc_label", f"""
with {DL}, {AUC_SQL.format(score='n_words', label='quality', src='dl')}
select round(case when P > 0 and N > 0 then (rsum - P * (P + 1) / 2) / (P * N) end, 6) as auc from a
""")
def q_auc(spark, sf):
    return rounded(M.roc_auc(doc_label(spark, sf), "n_words", "quality"))


@register("roc_auc_user_day", f"""
with {UD}, {AUC_SQL.format(score='g', label='label', src='ud')}
select round(case when P > 0 and N > 0 then (rsum - P * (P + 1) / 2) / (P * N) end, 6) as auc from a
""")
def q_auc2(spark, sf):
    # event count as the score: few distinct values, so ties dominate
    return rounded(M.roc_auc(_ud(spark, sf), "g", "label"))


AP_SQL = """
s as (select {score} as s, cast({label} as integer) as y from {src} where {score} is not null),
v as (select s, sum(y) as tp, count(*) as n from s group by s),
c as (select *, sum(tp) over (order by s desc rows between unbounded preceding and current row) as ctp,
             sum(n) over (order by s desc rows between unbounded preceding and current row) as cn from v)
"""


@register("average_precision", f"""
with {DL}, {AP_SQL.format(score='digit_share', label='toxic', src='dl')}
select round(case when sum(tp) > 0 then sum(tp * ctp / cn) / sum(tp) end, 6) as average_precision from c
""")
def q_ap(spark, sf):
    return rounded(M.average_precision(doc_label(spark, sf), "digit_share", "toxic"))


@register("log_loss", f"""
with {UD}, x as (select label, {pct_sql('mp')} as p from ud),
c as (select cast(label as double) as y, greatest(least(p, 1 - 1e-6), 1e-6) as p from x where p is not null)
select round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) as log_loss from c
""")
def q_ll(spark, sf):
    scored = W.percent_rank_avg(_ud(spark, sf), "period", "mp")
    return rounded(M.log_loss(scored, "mp_pct", "label"))


SCORED_SQL = f"""
{UD}, sp as (
  select *, case when period >= 27 then 'test' when period >= 24 then 'val' else 'train' end as split from ud),
m as (
  select 'mp' as model, 'user_day' as award, split, period, entity, label, {pct_sql('mp')} as score from sp
  union all
  select 'g' as model, 'user_day' as award, split, period, entity, label, {pct_sql('g')} as score from sp)
"""


def _scored_models(spark, sf):
    ud = W.temporal_split_last_k(_ud(spark, sf), "period", 3, 3)
    a = W.percent_rank_avg(ud, "period", "mp").select(
        F.lit("mp").alias("model"), F.lit("user_day").alias("award"), "split", "period", "entity", "label",
        F.col("mp_pct").alias("score"))
    b = W.percent_rank_avg(ud, "period", "g").select(
        F.lit("g").alias("model"), F.lit("user_day").alias("award"), "split", "period", "entity", "label",
        F.col("g_pct").alias("score"))
    return a.unionByName(b)


MBA_SQL = f"""
with {SCORED_SQL},
s as (select * from m where split in ('val', 'test')),
v as (select award, model, split, score, sum(label) as pos, count(*) - sum(label) as neg, count(*) as n
      from s where score is not null group by all),
rk as (select *, sum(n) over (partition by award, model, split order by score rows between unbounded preceding and current row) - n as before from v),
auc as (select award, model, split,
          case when sum(pos) > 0 and sum(neg) > 0 then (sum(pos * (before + (n + 1) / 2.0)) - sum(pos) * (sum(pos) + 1) / 2.0) / (cast(sum(pos) as double) * sum(neg)) end as auc
        from rk group by all),
r as (select award, model, split, period, label, row_number() over (partition by award, model, split, period order by score desc, entity) as rk
      from s where score is not null),
w as (select award, model, split, period, min(rk) as wr from r where label = 1 group by all),
rep as (select award, model, split, avg(case when wr <= 1 then 1.0 else 0.0 end) as h1, avg(case when wr <= 5 then 1.0 else 0.0 end) as h5,
               avg(1.0 / wr) as mrr, avg(cast(wr as double)) as mwr, count(*) as n from w group by all),
b as (select * from auc full join rep using (award, model, split))
select award, model,
  round(max(case when split = 'val' then auc end), 6) as val_auc, round(max(case when split = 'test' then auc end), 6) as test_auc,
  round(max(case when split = 'val' then h1 end), 6) as val_hit_at_1, round(max(case when split = 'val' then h5 end), 6) as val_hit_at_5,
  round(max(case when split = 'val' then mrr end), 6) as val_mrr,
  round(max(case when split = 'test' then h1 end), 6) as test_hit_at_1, round(max(case when split = 'test' then h5 end), 6) as test_hit_at_5,
  round(max(case when split = 'test' then mrr end), 6) as test_mrr,
  round(max(case when split = 'test' then mwr end), 6) as test_mean_winner_rank,
  coalesce(max(case when split = 'test' then n end), 0) as n_test_seasons
from b group by award, model
"""


@register("metrics_by_award", MBA_SQL)
def q_mba(spark, sf):
    return rounded(M.metrics_by_award(_scored_models(spark, sf), "period", "score", "label", ["entity"]))


@register("metrics_table", MBA_SQL)
def q_mt(spark, sf):
    return K.metrics_table(q_mba(spark, sf), tiebreak=["model"])


@register("generalization_gap", f"""
select award, model, round(test_auc - val_auc, 6) as gap from ({MBA_SQL}) t
""")
def q_gap(spark, sf):
    return rounded(M.generalization_gap(q_mba(spark, sf)).select("award", "model", "gap"))


@register("melt_metrics", f"""
select award, model, metric, value from (
  unpivot ({MBA_SQL}) on val_auc, test_auc, val_mrr, test_mrr into name metric value value)
where value is not null
""")
def q_melt(spark, sf):
    return K.melt_metrics(q_mba(spark, sf), ["award", "model"], ["val_auc", "test_auc", "val_mrr", "test_mrr"])


# ---------------------------------------------------------------------------
# Eligibility (user_day under the reference's column names; thresholds that
# do not fit event counts are stated per query)
# ---------------------------------------------------------------------------
MEDS_SQL = """
meds as (select season, median(MP / nullif(cast(G as double), 0)) as med_r, median(MP) as med_m from {src} group by season),
mpg as (select s.*, case when m.med_r < 3 and m.med_m between 5 and 45 then MP else MP / nullif(cast(G as double), 0) end as mpg
        from {src} s left join meds m on s.season = m.season)
"""


@register("per_game_minutes", f"""
with {UDN}, {MEDS_SQL.format(src='udn')}
select Player, season, round(mpg, 6) as mpg from mpg
""")
def q_mpg(spark, sf):
    return rounded(E.per_game_minutes(_udn(spark, sf), "mpg", "season").select("Player", "season", "mpg"))


@register("eligible_mvp", f"""
with {UDN}, pos as (select * from udn where coalesce(MP, 0) > 0), {MEDS_SQL.format(src='pos')}
select Player, season from mpg where coalesce(mpg, 0) >= 25
""")
def q_mvp(spark, sf):
    return E.apply_eligibility(_udn(spark, sf), "mvp", "season").select("Player", "season")


@register("eligible_dpoy", f"""
with {UDN}, pos as (select * from udn where coalesce(MP, 0) > 0), {MEDS_SQL.format(src='pos')}
select Player, season from mpg where coalesce(mpg, 0) >= 20 and coalesce(G, 0) >= 3
""")
def q_dpoy(spark, sf):
    # at most a handful of events per user-day: games floor 3 instead of 40
    return E.apply_eligibility(_udn(spark, sf), "dpoy", "season", g_min=3).select("Player", "season")


@register("eligible_smoy", f"""
with {UDN}
select Player, season from udn
where coalesce(GS / nullif(cast(G as double), 0), 0) < 0.5 and coalesce(MP, 0) > 0
""")
def q_smoy(spark, sf):
    return E.apply_eligibility(_udn(spark, sf), "smoy", "season").select("Player", "season")


@register("eligible_smoy_strict", f"""
with {UDN} select Player, season from udn where coalesce(GS <= G - GS, false)
""")
def q_smoy2(spark, sf):
    return E.eligible_smoy_strict(_udn(spark, sf)).select("Player", "season")


@register("eligible_roy", f"""
with {UDN}, f as (select season, max(case when coalesce(is_rookie, 0) = 1 then 1 else 0 end) as any_flag from udn group by season)
select u.Player, u.season from udn u join f on u.season = f.season
where (f.any_flag = 1 and u.is_rookie = 1) or f.any_flag = 0
""")
def q_roy(spark, sf):
    # periods with no first-day user fall back to everyone (no rookie list given)
    return E.apply_eligibility(_udn(spark, sf), "roy", "season").select("Player", "season")


def _cy_named(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("Player"))
    return cust_year(spark, sf).join(c, "entity", "left")


CYN = f"{CY}, cyn as (select cy.*, c.c_name as Player from cy left join customer c on cy.entity = c.c_custkey)"
ROOKIE_LIST_SQL = "select '  ' || c_name || ' ' as Player from customer where c_mktsegment = 'BUILDING'"


def _rookie_list(spark, sf):
    # names padded with blanks: matching trims them (and duplicates are harmless)
    c = table(spark, sf, "customer")
    return c.where(F.col("c_mktsegment") == "BUILDING").select(
        F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("Player"))


@register("eligible_roy_list", f"""
with {CYN}
select Player, period from cyn where trim(Player) in (select trim(Player) from ({ROOKIE_LIST_SQL}) l)
""")
def q_roy_list(spark, sf):
    df = _cy_named(spark, sf).drop("is_rookie")
    return E.apply_eligibility(df, "roy", "period", rookies=_rookie_list(spark, sf)).select("Player", "period")


@register("flag_members", f"""
with {CYN}
select entity, period, Player,
  cast(trim(Player) in (select trim(Player) from ({ROOKIE_LIST_SQL}) l) as integer) as is_rookie
from cyn
""")
def q_flag(spark, sf):
    out = J.flag_members(_cy_named(spark, sf), _rookie_list(spark, sf), "Player", "Player", "is_rookie")
    return out.select("entity", "period", "Player", "is_rookie")


def _udn_prev(spark, sf):
    return W.add_prev_features(_udn(spark, sf), "Player", "season", ["MP", "G"])


@register("eligible_mip", f"""
with {UDN}, p as (select *, lag(MP) over (partition by Player order by season) as prev_MP from udn),
f as (select * from p where coalesce(is_rookie, 0) = 0 and coalesce(G, 0) >= 2), {MEDS_SQL.format(src='f')}
select Player, season from mpg where coalesce(mpg, 0) >= 15 and coalesce(prev_MP, 0) > 0
""")
def q_mip(spark, sf):
    # two events a day instead of 20 games
    return E.apply_eligibility(_udn_prev(spark, sf), "mip", "season", min_g=2).select("Player", "season")


@register("eligible_mip_strict", f"""
with {UDN}, p as (select *, lag(season) over w as ps, lag(G) over w as pg from udn window w as (partition by Player order by season))
select Player, season, case when ps = season - 1 then pg end as prev_G, cast(coalesce(ps = season - 1, false) as integer) as mip_has_prev_season
from p where ps = season - 1 and coalesce(is_rookie, 0) != 1 and coalesce(G, 0) >= 2 and coalesce(pg, 0) >= 2
""")
def q_mip2(spark, sf):
    out = E.eligible_mip_strict(_udn(spark, sf), "Player", "season", min_g=2, min_g_prev=2)
    return out.select("Player", "season", "prev_G", "mip_has_prev_season")


@register("prev_period_join", f"""
with {UDN}, p as (select *, lag(season) over w as ps, lag(MP) over w as pm, lag(G) over w as pg from udn
                  window w as (partition by Player order by season))
select Player, season, case when ps = season - 1 then pm end as prev_MP, case when ps = season - 1 then pg end as prev_G
from p
""")
def q_j1(spark, sf):
    out = J.prev_period_join(_udn(spark, sf), "Player", "season", ["MP", "G"])
    return rounded(out.select("Player", "season", "prev_MP", "prev_G"))


@register("lag_vs_strict_previous", f"""
with {UDN}, p as (select *, lag(season) over w as ps from udn window w as (partition by Player order by season))
select count(*) as n_rows, cast(sum(case when ps is not null and ps != season - 1 then 1 else 0 end) as bigint) as n_differ from p
""")
def q_t8(spark, sf):
    a = W.add_prev_features(_udn(spark, sf), "Player", "season", ["season"], prefix="lag_")
    b = J.prev_period_join(a, "Player", "season", ["season"], prefix="strict_")
    return b.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum((F.col("lag_season").isNotNull() & ~F.col("lag_season").eqNullSafe(F.col("strict_season")))
                       .cast("long")).alias("n_differ"))


@register("period_between", f"""
with {UDN} select Player, season from udn where season between 5 and 10
""")
def q_between(spark, sf):
    return E.period_between(_udn(spark, sf), "season", 5, 10).select("Player", "season")


@register("drop_invalid_periods", f"""
with {UDN}, p as (select *, lag(MP) over (partition by Player order by season) as prev_MP from udn),
f as (select * from p where coalesce(is_rookie, 0) = 0 and coalesce(G, 0) >= 2), {MEDS_SQL.format(src='f')},
e as (select * from mpg where coalesce(mpg, 0) >= 15 and coalesce(prev_MP, 0) > 0),
ok as (select season from e group by season having sum(coalesce(label, 0)) = 1)
select Player, season from e where season in (select season from ok)
""")
def q_e13(spark, sf):
    e = E.apply_eligibility(_udn_prev(spark, sf), "mip", "season", min_g=2)
    return E.drop_invalid_periods(e, "season", "label").select("Player", "season")


@register("complete_cases", f"""
with {UDN}, p as (select *, lag(MP) over w as prev_MP, lag(G) over w as prev_G from udn window w as (partition by Player order by season))
select Player, season from p where prev_MP is not null and prev_G is not null
""")
def q_cc(spark, sf):
    return E.complete_cases(_udn_prev(spark, sf), ["prev_MP", "prev_G"], "any").select("Player", "season")


MISSING_SQL = f"""
with {UDN}, p as (select Player, season, MP, lag(MP) over w as prev_MP, lag(G) over w as prev_G from udn
                  window w as (partition by Player order by season)),
r as (select avg(case when Player is null then 1.0 else 0.0 end) as Player, avg(case when season is null then 1.0 else 0.0 end) as season,
             avg(case when MP is null then 1.0 else 0.0 end) as MP, avg(case when prev_MP is null then 1.0 else 0.0 end) as prev_MP,
             avg(case when prev_G is null then 1.0 else 0.0 end) as prev_G from p),
u as (unpivot r on Player, season, MP, prev_MP, prev_G into name "column" value missing_rate)
"""


@register("missing_rate", MISSING_SQL + 'select "column", round(missing_rate, 6) as missing_rate from u')
def q_missing(spark, sf):
    df = _udn_prev(spark, sf).select("Player", "season", "MP", "prev_MP", "prev_G")
    return rounded(E.missing_rates(df))


@register("missing_rate_filter", MISSING_SQL + 'select "column", round(missing_rate, 6) as missing_rate from u where missing_rate > 0.02')
def q_missing_f(spark, sf):
    # the first day of every user has no previous value: a few percent missing
    df = _udn_prev(spark, sf).select("Player", "season", "MP", "prev_MP", "prev_G")
    return rounded(E.missing_rate_filter(df, 0.02))


# ---------------------------------------------------------------------------
# Aggregations
# ---------------------------------------------------------------------------
@register("dedup_most_complete", """
with e as (select e.*, l.quality from events e left join labels l on e.event_id = l.doc_id),
s as (select *, (case when quality is null then 0 else 1 end) as nn from e),
r as (select *, row_number() over (partition by user_id, event_type order by nn desc, event_id) as rn from s)
select user_id, event_type, event_id, quality from r where rn = 1
""")
def q_g1(spark, sf):
    # events carry a quality value only where an event id is also a labelled document id
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("event_id"), "quality")
    return G.dedup_most_complete(e.join(lab, "event_id", "left"), ["user_id", "event_type"], "event_id")


@register("describe_numeric", f"""
with {UDN}, u as (unpivot (select cast(G as double) as G, cast(GS as double) as GS, MP, PTS from udn) on G, GS, MP, PTS into name feature value value)
select feature, count(value) as count, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std,
  round(min(value), 6) as min, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50,
  round(quantile_cont(value, 0.75), 6) as p75, round(max(value), 6) as max
from u group by feature
""")
def q_g2(spark, sf):
    return rounded(G.describe_numeric(_udn(spark, sf), ["G", "GS", "MP", "PTS"]))


@register("rows_per_period", f"""
with {CY} select period, count(*) as n_rows from cy group by period
""")
def q_g3(spark, sf):
    return G.rows_per_period(cust_year(spark, sf), "period")


@register("count_wins", f"""
with {UD}, r as (select entity, period, row_number() over (partition by period order by mp desc, entity) as rk from ud),
w as (select entity, count(distinct period) as n_wins from r where rk = 1 group by entity)
select entity, n_wins from w order by n_wins desc, entity limit 15
""")
def q_g4(spark, sf):
    r = W.rank_in_period(_ud(spark, sf), "period", "mp", ["entity"], "mp_rank")
    return G.count_wins(r, "entity", "period", "mp_rank")


@register("count_selections", f"""
with {UD}, p as (select entity, lag(mp) over (partition by entity order by period) as prev_mp from ud),
c as (select entity, count(*) as n_selections from p where prev_mp is not null group by entity)
select entity, n_selections from c order by n_selections desc, entity limit 15
""")
def q_g5(spark, sf):
    p = W.add_prev_features(_ud(spark, sf), "entity", "period", ["mp"])
    return G.count_selections(p, "entity", "prev_mp")


@register("winners_per_period", f"""
with {UD}, p as (select period, sum(coalesce(is_rookie, 0)) as n_pos from ud group by period)
select cast(min(n_pos) as double) as min_pos, round(median(n_pos), 6) as median_pos, cast(max(n_pos) as double) as max_pos,
  count(*) as n_periods, cast(sum(case when n_pos = 0 then 1 else 0 end) as bigint) as n_zero from p
""")
def q_g6(spark, sf):
    # first-day users as the positives: many on day 0, few or none later
    return rounded(G.winners_per_period(_ud(spark, sf), "period", "is_rookie"))


@register("periods_without_positive", f"""
with {UD} select period from ud group by period having sum(coalesce(is_rookie, 0)) = 0
""")
def q_g6b(spark, sf):
    return G.periods_without_positive(_ud(spark, sf), "period", "is_rookie")


SPLIT_UD = f"""{UD}, sp as (select *, case when period >= 27 then 'test' when period >= 24 then 'val' else 'train' end as split from ud)"""


@register("label_distribution", f"""
with {SPLIT_UD},
cls as (select split, cast(coalesce(label, 0) as integer) as y, count(*) as n from sp group by all),
tot as (select split, sum(n) as tot from cls group by split),
span as (select split, min(period) as period_min, max(period) as period_max, avg(cast(coalesce(label, 0) as double)) as positive_rate from sp group by split),
per as (select split, period, sum(coalesce(label, 0)) as n_pos from sp group by all),
w as (select split, cast(min(n_pos) as double) as min_pos, median(n_pos) as median_pos, cast(max(n_pos) as double) as max_pos,
             count(*) as n_periods, cast(sum(case when n_pos = 0 then 1 else 0 end) as bigint) as n_zero from per group by split)
select cls.split, cls.y, cls.n, round(cls.n / tot.tot, 6) as ratio, span.period_min, span.period_max, round(span.positive_rate, 6) as positive_rate,
       w.min_pos, round(w.median_pos, 6) as median_pos, w.max_pos, w.n_periods, w.n_zero
from cls join tot using (split) join span using (split) join w using (split)
""")
def q_g7(spark, sf):
    s = W.temporal_split_last_k(_ud(spark, sf), "period", 3, 3)
    return rounded(G.label_distribution(s, "split", "label", "period"))


@register("describe_split", f"""
with {SPLIT_UD}
select split, count(*) as n_rows, count(distinct period) as n_periods, min(period) as period_min, max(period) as period_max,
       cast(sum(coalesce(label, 0)) as bigint) as n_pos from sp group by split
""")
def q_g8(spark, sf):
    s = W.temporal_split_last_k(_ud(spark, sf), "period", 3, 3)
    return G.describe_split(s, "split", "period", "label")


@register("period_coverage", f"""
with {CY}, d as (select distinct period from cy)
select min(period) as period_min, max(period) as period_max, count(*) as n_periods,
       (select list(period order by period) from (select period from d order by period desc limit 5)) as last_periods
from d
""")
def q_g10(spark, sf):
    return G.period_coverage(cust_year(spark, sf), "period")


@register("correlation_matrix", f"""
with {UDN}, c as (select cast(G as double) as G, cast(GS as double) as GS, MP, PTS from udn where G is not null and GS is not null and MP is not null and PTS is not null)
select * from (
  select 'GS' as col_a, 'G' as col_b, round(covar_samp(GS, G) / (stddev_samp(GS) * stddev_samp(G)), 6) as corr from c
  union all select 'MP', 'G', round(covar_samp(MP, G) / (stddev_samp(MP) * stddev_samp(G)), 6) from c
  union all select 'MP', 'GS', round(covar_samp(MP, GS) / (stddev_samp(MP) * stddev_samp(GS)), 6) from c
  union all select 'PTS', 'G', round(covar_samp(PTS, G) / (stddev_samp(PTS) * stddev_samp(G)), 6) from c
  union all select 'PTS', 'GS', round(covar_samp(PTS, GS) / (stddev_samp(PTS) * stddev_samp(GS)), 6) from c
  union all select 'PTS', 'MP', round(covar_samp(PTS, MP) / (stddev_samp(PTS) * stddev_samp(MP)), 6) from c) t
""")
def q_g11(spark, sf):
    return rounded(G.correlation_matrix(_udn(spark, sf), ["G", "GS", "MP", "PTS"]))


@register("linear_trend", f"""
with {CY} select round(regr_slope(mp, cast(period as double) - 1995), 6) as slope,
  round(avg(mp) - regr_slope(mp, cast(period as double) - 1995) * avg(cast(period as double) - 1995), 6) as intercept,
  cast(regr_count(mp, cast(period as double)) as bigint) as n from cy where mp is not null and period is not null
""")
def q_g12(spark, sf):
    # the intercept is the value at 1995, not at year 0
    centred = cust_year(spark, sf).withColumn("years", F.col("period").cast("double") - 1995)
    return rounded(G.linear_trend(centred, "years", "mp"))


@register("box_summary", f"""
with {UDN}, q as (select season, quantile_cont(MP, 0.25) as q1, quantile_cont(MP, 0.5) as median, quantile_cont(MP, 0.75) as q3,
                         count(MP) as n from udn group by season),
f as (select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lo_fence, q3 + 1.5 * (q3 - q1) as hi_fence from q),
e as (select u.season, min(case when MP >= lo_fence then MP end) as whisker_lo, max(case when MP <= hi_fence then MP end) as whisker_hi,
             cast(sum(case when MP < lo_fence or MP > hi_fence then 1 else 0 end) as bigint) as n_outliers
      from udn u join f using (season) group by u.season)
select season, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, n, round(iqr, 6) as iqr,
       round(lo_fence, 6) as lo_fence, round(hi_fence, 6) as hi_fence, round(whisker_lo, 6) as whisker_lo,
       round(whisker_hi, 6) as whisker_hi, n_outliers
from f join e using (season)
""")
def q_g13(spark, sf):
    return rounded(G.box_summary(_udn(spark, sf), "season", "MP"))


@register("winner_loser_profile", f"""
with {UDN}, u as (unpivot (select cast(coalesce(label, 0) as integer) as y, cast(G as double) as G, cast(GS as double) as GS, MP from udn)
                  on G, GS, MP into name feature value value),
s as (select feature, y, avg(value) as mean, median(value) as median from u group by all),
w as (select feature, max(case when y = 1 then mean end) as mean_winner, max(case when y = 0 then mean end) as mean_other,
             max(case when y = 1 then median end) as median_winner, max(case when y = 0 then median end) as median_other from s group by feature)
select feature, round(mean_winner, 6) as mean_winner, round(mean_other, 6) as mean_other, round(median_winner, 6) as median_winner,
       round(median_other, 6) as median_other, round(mean_winner - mean_other, 6) as diff
from w order by abs(mean_winner - mean_other) desc, feature limit 30
""")
def q_g14(spark, sf):
    return rounded(G.winner_loser_profile(_udn(spark, sf), "label", ["G", "GS", "MP"]))


@register("class_balance", f"""
with {DL} select cast(sum(case when quality > 0 then 1 else 0 end) as bigint) as n_pos,
  cast(sum(case when coalesce(quality, 0) <= 0 then 1 else 0 end) as bigint) as n_neg from dl
""")
def q_g15(spark, sf):
    return G.class_balance(doc_label(spark, sf), "quality")


@register("seed_mean_std", f"""
with {DL} select lang, round(avg(n_words), 6) as n_words_mean, round(coalesce(stddev_samp(n_words), 0), 6) as n_words_std,
  round(avg(digit_share), 6) as digit_share_mean, round(coalesce(stddev_samp(digit_share), 0), 6) as digit_share_std,
  count(*) as n_runs from dl group by lang
""")
def q_g16(spark, sf):
    return rounded(G.seed_mean_std(doc_label(spark, sf), ["lang"], ["n_words", "digit_share"]))


# ---------------------------------------------------------------------------
# Joins and set membership
# ---------------------------------------------------------------------------
@register("semi_filter", f"""
with {UDN} select Player, season from udn where Player in (select user_id from events where value > 450)
""")
def q_j5(spark, sf):
    big = table(spark, sf, "events", [("value", ">", 450.0)]).select("user_id")
    return J.semi_filter(_udn(spark, sf), "Player", big, "user_id").select("Player", "season")


@register("compare_runs", f"""
with m as ({MBA_SQL}),
b as (select award, val_mrr, test_mrr, val_hit_at_1 as val_top1, test_hit_at_1 as test_top1 from m where model = 'g'),
t as (select award, val_mrr, test_mrr, val_hit_at_1 as val_top1, test_hit_at_1 as test_top1 from m where model = 'mp')
select award, b.val_mrr as baseline_val_mrr, b.test_mrr as baseline_test_mrr, b.val_top1 as baseline_val_top1, b.test_top1 as baseline_test_top1,
  t.val_mrr as tree_val_mrr, t.test_mrr as tree_test_mrr, t.val_top1 as tree_val_top1, t.test_top1 as tree_test_top1,
  round(t.val_mrr - b.val_mrr, 6) as delta_val_mrr, round(t.test_mrr - b.test_mrr, 6) as delta_test_mrr,
  round(t.val_top1 - b.val_top1, 6) as delta_val_top1, round(t.test_top1 - b.test_top1, 6) as delta_test_top1
from b join t using (award)
""")
def q_j6(spark, sf):
    m = q_mba(spark, sf).withColumnRenamed("val_hit_at_1", "val_top1").withColumnRenamed("test_hit_at_1", "test_top1")
    return rounded(J.compare_runs(m.where(F.col("model") == "g"), m.where(F.col("model") == "mp"), "award", run_col=None))


@register("union_by_name", f"""
with {UD}, {CY}
select entity, period, mp, null as Pos, null as Tm from ud
union all select entity, period, mp, Pos, Tm from cy
""")
def q_j7(spark, sf):
    a = _ud(spark, sf).select("entity", "period", "mp")
    b = cust_year(spark, sf).select("entity", "period", "mp", "Pos", "Tm")
    return J.union_by_name(a, b)


@register("audit_alignment", f"""
with {UD}, x as (select entity, period from ud where period > 0)
select (select count(*) from ud) as n_df, (select count(*) from x) as n_features, (select count(*) from ud) as n_labels,
  (select count(*) from ud where (entity, period) not in (select (entity, period) from x)) as keys_missing_in_features,
  cast(0 as bigint) as keys_missing_in_df,
  (select count(*) from (select period from ud group by period having sum(coalesce(label, 0)) != 1) t) as periods_not_one_winner
""")
def q_j8(spark, sf):
    ud = _ud(spark, sf)
    feats = ud.where(F.col("period") > 0).select("entity", "period")
    return J.audit_alignment(ud, feats, ud, ["entity", "period"], "period", "label")


# ---------------------------------------------------------------------------
# Scalar functions and shaping
# ---------------------------------------------------------------------------
SEASON_TEXT_SQL = """
st as (
  select distinct txt from (
    select cast(year(o_orderdate) as varchar) as txt from orders
    union all select cast(year(o_orderdate) - 1 as varchar) || '-' || lpad(cast(year(o_orderdate) % 100 as varchar), 2, '0') from orders
    union all select ' ' || cast(year(o_orderdate) - 1 as varchar) || ' - ' || cast(year(o_orderdate) as varchar) from orders
    union all select cast(year(o_orderdate) as varchar) || '-' || lpad(cast((year(o_orderdate) + 5) % 100 as varchar), 2, '0') from orders
    union all select o_orderpriority from orders
    union all select o_orderstatus from orders) t)
"""


def _season_texts(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), "o_orderpriority", "o_orderstatus")
    y = F.col("y")
    forms = [y.cast("string"),
             F.concat((y - 1).cast("string"), F.lit("-"), F.lpad((y % 100).cast("string"), 2, "0")),
             F.concat(F.lit(" "), (y - 1).cast("string"), F.lit(" - "), y.cast("string")),
             F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 5) % 100).cast("string"), 2, "0")),
             F.col("o_orderpriority"), F.col("o_orderstatus")]
    return o.select(F.explode(F.array(*forms)).alias("txt")).distinct()


@register("parse_season_end", f"""
with {SEASON_TEXT_SQL},
p as (select txt, trim(txt) as s,
        trim(regexp_extract(trim(txt), '^([^-]*)-(.*)$', 1)) as head, trim(regexp_extract(trim(txt), '^([^-]*)-(.*)$', 2)) as tail from st)
select txt, case
  when s is null or s = '' then null
  when regexp_full_match(s, '[0-9]+') then try_cast(s as integer)
  when contains(s, '-') and regexp_full_match(head, '[0-9]{{4}}') and regexp_full_match(tail, '[0-9]{{2}}') then
    case when try_cast(tail as integer) = (try_cast(head as integer) + 1) % 100 then try_cast(head as integer) + 1
         else try_cast(substr(head, 1, 2) || tail as integer) end
  when contains(s, '-') and regexp_full_match(tail, '[0-9]{{4}}') then try_cast(tail as integer)
  else null end as season_end
from p
""")
def q_p3(spark, sf):
    t = _season_texts(spark, sf)
    return t.select("txt", S.parse_season_end("txt").alias("season_end"))


@register("season_label", f"""
with {CY} select distinct period, cast(period - 1 as varchar) || '-' || lpad(cast(period % 100 as varchar), 2, '0') as label from cy
""")
def q_p4(spark, sf):
    return cust_year(spark, sf).select("period", S.season_label("period").alias("label")).distinct()


@register("as_binary", """
select o_orderkey, cast(coalesce(o_totalprice - 150000 > 0, false) as integer) as big_order,
       cast(coalesce(try_cast(o_orderstatus as double) > 0, false) as integer) as status_flag from orders
""")
def q_p7(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", S.as_binary(F.col("o_totalprice") - 150000).alias("big_order"),
                    S.as_binary("o_orderstatus").alias("status_flag"))


@register("value_formats", f"""
with {DL}, x as (select *, {pct_sql('n_words', 'lang')} as p from dl)
select doc_id, coalesce(case lang when 'en' then 'english' when 'fr' then 'french' end, lang) as lang_name,
  round(greatest(least(p, 1 - 1e-6), 1e-6), 6) as p_clipped,
  coalesce(printf('%.3f', digit_share), '') as digit_share_3dp from x
""")
def q_p14(spark, sf):
    d = W.percent_rank_avg(doc_label(spark, sf), "lang", "n_words", names=["p"])
    return rounded(d.select("doc_id", S.map_values("lang", {"en": "english", "fr": "french"}).alias("lang_name"),
                            S.clip_probability("p").alias("p_clipped"),
                            S.format_3dp("digit_share").alias("digit_share_3dp")))


@register("to_percent_0_100", f"""
with {DL}, m as (select max(digit_share) as md, max(n_words) as mw from dl)
select doc_id, round(case when md <= 1 then digit_share * 100 else digit_share end, 6) as digit_share,
       round(case when mw <= 1 then n_words * 100 else n_words end, 6) as n_words from dl, m
""")
def q_p13(spark, sf):
    d = doc_label(spark, sf).select("doc_id", "digit_share", "n_words")
    return rounded(P.to_percent_0_100(d, ["digit_share", "n_words"]))


@register("one_hot", f"""
with {CY} select entity, period,
  case when coalesce(Pos, 'UNK') = 'AUTOMOBILE' then 1 else 0 end as Pos_AUTOMOBILE,
  case when coalesce(Pos, 'UNK') = 'BUILDING' then 1 else 0 end as Pos_BUILDING,
  case when coalesce(Pos, 'UNK') = 'FURNITURE' then 1 else 0 end as Pos_FURNITURE,
  case when coalesce(Pos, 'UNK') = 'HOUSEHOLD' then 1 else 0 end as Pos_HOUSEHOLD,
  case when coalesce(Pos, 'UNK') = 'MACHINERY' then 1 else 0 end as Pos_MACHINERY,
  case when coalesce(Pos, 'UNK') = 'UNK' then 1 else 0 end as Pos_UNK
from cy
""")
def q_p9(spark, sf):
    oh = P.one_hot(cust_year(spark, sf).select("entity", "period", "Pos"), "Pos")
    return oh


# ---------------------------------------------------------------------------
# Leakage
# ---------------------------------------------------------------------------
@register("corr_leakage", f"""
with {DL}, x as (select *, cast(quality as double) as quality_copy from dl),
c as (select 'n_chars' as feature, corr(n_chars, quality) as corr, count(n_chars) as n, stddev_samp(n_chars) as s from x
      union all select 'n_words', corr(n_words, quality), count(n_words), stddev_samp(n_words) from x
      union all select 'digit_share', corr(digit_share, quality), count(digit_share), stddev_samp(digit_share) from x
      union all select 'quality_copy', corr(quality_copy, quality), count(quality_copy), stddev_samp(quality_copy) from x)
select feature, round(corr, 6) as corr from c where n >= 25 and s > 1e-12 and abs(corr) >= 0.95
""")
def q_l2(spark, sf):
    # a copied label column is the leak the check must find
    d = doc_label(spark, sf).withColumn("quality_copy", F.col("quality").cast("double"))
    return rounded(L.corr_leakage(d, "quality", ["n_chars", "n_words", "digit_share", "quality_copy"]))


@register("feature_label_corr", f"""
with {UDN}, c as (
  select 'G' as feature, corr(cast(G as double), label) as corr, count(*) filter (where G is not null and label is not null) as n, stddev_samp(G) as s from udn
  union all select 'GS', corr(cast(GS as double), label), count(*) filter (where GS is not null and label is not null), stddev_samp(GS) from udn
  union all select 'MP', corr(MP, label), count(*) filter (where MP is not null and label is not null), stddev_samp(MP) from udn
  union all select 'PTS', corr(PTS, label), count(*) filter (where PTS is not null and label is not null), stddev_samp(PTS) from udn)
select feature, round(abs(corr), 6) as abs_corr, round(corr, 6) as corr from c where n >= 10 and s > 0 and corr is not null
""")
def q_l4(spark, sf):
    return rounded(L.feature_label_corr(_udn(spark, sf), "label", ["G", "GS", "MP", "PTS"]))


@register("full_data_points", f"""
with {UD}, per as (select period, count(*) as r, cast(sum(label) as bigint) as p from ud group by period),
idx as (select *, row_number() over (order by period) as i, count(*) over () as n from per),
fr as (select unnest([0.2, 0.4, 0.6, 0.8, 1.0]) as frac),
pairs as (select fr.frac, idx.* from fr join idx on idx.i <= ceil(fr.frac * idx.n)),
a as (select 'user_day' as source, 'count' as model, cast(frac as double) as frac, count(*) as n_periods,
             cast(sum(r) as bigint) as n_train_rows, cast(sum(p) as bigint) as n_pos, 'ok' as status from pairs group by frac),
m as (select *, max(frac) over (partition by source, model) as mx from a)
select source, model, frac, n_periods, n_train_rows, n_pos, status from m where frac = mx and status = 'ok'
""")
def q_r2(spark, sf):
    lc = W.learning_curve_folds(_ud(spark, sf), "period", "label").select(
        F.lit("user_day").alias("source"), F.lit("count").alias("model"), "frac", "n_periods", "n_train_rows",
        "n_pos", "status")
    return rounded(K.full_data_points(lc, ["source", "model"], "frac", "status", "n_train_rows"))


# ---------------------------------------------------------------------------
# Feature building and dataset builders
# ---------------------------------------------------------------------------
from . import datasets as B  # noqa: E402


@register("season_percentiles", f"""
with {UDN} select Player, season, round({pct_sql('G', 'season')}, 6) as pct_G, round({pct_sql('GS', 'season')}, 6) as pct_GS,
  round({pct_sql('MP', 'season')}, 6) as pct_MP from udn
""")
def q_u3(spark, sf):
    out = W.season_percentiles(_udn(spark, sf), "season", ["G", "GS", "MP"], ["Player"])
    return rounded(out.select("Player", "season", "pct_G", "pct_GS", "pct_MP"))


def _facts(spark, sf):
    """user_day facts with per-day percentiles and an explicit row id."""
    u = _udn(spark, sf).withColumn("__row_id", F.col("Player") * 100 + F.col("season"))
    return W.season_percentiles(u, "season", ["G", "GS", "MP"], ["Player"])


FACTS_SQL = f"""{UDN}, facts as (select *, Player * 100 + season as __row_id, {pct_sql('G', 'season')} as pct_G,
  {pct_sql('GS', 'season')} as pct_GS, {pct_sql('MP', 'season')} as pct_MP from udn)"""


@register("training_table", f"""
with {FACTS_SQL}, pos as (select * from facts where coalesce(MP, 0) > 0), {MEDS_SQL.format(src='pos')}
select season, Player, __row_id, round(pct_G, 6) as pct_G, round(pct_GS, 6) as pct_GS, round(pct_MP, 6) as pct_MP,
  cast(coalesce(label > 0, false) as integer) as label
from mpg where coalesce(mpg, 0) >= 25
""")
def q_b2(spark, sf):
    out, spec = B.build_training_table(_facts(spark, sf), "mvp", "label", entity_col="Player", period_col="season")
    return rounded(out)


@register("training_table_mip", f"""
with {FACTS_SQL},
p as (select *, lag(pct_G) over w as prev_pct_G, lag(pct_GS) over w as prev_pct_GS, lag(pct_MP) over w as prev_pct_MP,
             lag(MP) over w as prev_MP from facts window w as (partition by Player order by season, __row_id)),
f as (select * from p where season > (select min(season) from facts) and coalesce(is_rookie, 0) = 0 and coalesce(G, 0) >= 2),
{MEDS_SQL.format(src='f')}
select season, Player, __row_id, round(pct_G, 6) as pct_G, round(pct_GS, 6) as pct_GS, round(pct_MP, 6) as pct_MP,
  round(prev_pct_G, 6) as prev_pct_G, round(prev_pct_GS, 6) as prev_pct_GS, round(prev_pct_MP, 6) as prev_pct_MP,
  round(pct_G - prev_pct_G, 6) as delta_pct_G, round(pct_GS - prev_pct_GS, 6) as delta_pct_GS, round(pct_MP - prev_pct_MP, 6) as delta_pct_MP,
  cast(coalesce(label > 0, false) as integer) as label
from mpg where coalesce(mpg, 0) >= 15 and coalesce(prev_MP, 0) > 0
""")
def q_b2m(spark, sf):
    out, spec = B.build_training_table(_facts(spark, sf), "mip", "label", entity_col="Player", period_col="season",
                                       eligibility={"min_g": 2})
    return rounded(out)


@register("target_matrix", f"""
with {FACTS_SQL}, t as (select * from facts where season = 20), pos as (select * from t where coalesce(MP, 0) > 0),
{MEDS_SQL.format(src='pos')}
select season, Player, __row_id, round(pct_G, 6) as pct_G, round(pct_GS, 6) as pct_GS, round(pct_MP, 6) as pct_MP
from mpg where coalesce(mpg, 0) >= 25
""")
def q_b1(spark, sf):
    f = _facts(spark, sf)
    hist = f.where(F.col("season") < 20).drop("__row_id")
    target = f.where(F.col("season") == 20)
    out, spec = B.build_target_matrix(hist, target, 20, "mvp")
    return rounded(out)


@register("award_dataset", f"""
with {UDN}
select Player, season, G, GS, MP, cast(coalesce(label, 0) as integer) as y from udn
where coalesce(GS / nullif(cast(G as double), 0), 0) < 0.5 and coalesce(MP, 0) > 0
""")
def q_b3(spark, sf):
    u = _udn(spark, sf)
    return rounded(B.build_award_dataset(u, E.eligible_smoy(u, "season"), "label", ["G", "GS", "MP"], ["Player", "season"]))


@register("mip_dataset", f"""
with {UDN}, p as (select *, lag(season) over w as ps, lag(G) over w as pg, lag(MP) over w as pm from udn
                  window w as (partition by Player order by season))
select Player, season, MP, G, round(MP - pm, 6) as delta_MP, round(cast(G as double) - pg, 6) as delta_G,
  pg as prev_G, 1 as mip_has_prev_season, cast(coalesce(label, 0) as integer) as y
from p where ps = season - 1 and coalesce(is_rookie, 0) != 1 and coalesce(G, 0) >= 2 and coalesce(pg, 0) >= 2
""")
def q_b4(spark, sf):
    out = B.build_mip_dataset(_udn(spark, sf), "Player", "season", "label", ["MP", "G"], min_g=2, min_g_prev=2)
    return rounded(out)


# ---------------------------------------------------------------------------
# Model preprocessing (exact, SQL-checkable) and model selection on given scores
# ---------------------------------------------------------------------------
from . import models as ML  # noqa: E402
from . import prefix_stats as PX  # noqa: E402
from . import studies as ST  # noqa: E402
from . import predict as PR  # noqa: E402
from ..sources import readers as R  # noqa: E402
from ..sources import writers as WR  # noqa: E402


@register("median_impute", f"""
with {UDN}, p as (select Player, season, lag(MP) over w as prev_MP, cast(lag(G) over w as double) as prev_G from udn
                  window w as (partition by Player order by season)),
m as (select median(prev_MP) as mm, median(prev_G) as mg from p where season < 24)
select Player, season, round(coalesce(prev_MP, mm), 6) as prev_MP, round(coalesce(prev_G, mg), 6) as prev_G from p, m
""")
def q_ml1(spark, sf):
    # medians fitted on the training days (< 24) only, applied to every row
    p = _udn_prev(spark, sf).select("Player", "season", "prev_MP", F.col("prev_G").cast("double").alias("prev_G"))
    imp = ML.MedianImputer.fit(p.where(F.col("season") < 24), ["prev_MP", "prev_G"])
    return rounded(imp.transform(p))


@register("median_table", f"""
with {UDN}, p as (select lag(MP) over w as prev_MP, cast(lag(G) over w as double) as prev_G, MP from udn
                  window w as (partition by Player order by season))
select 'prev_MP' as feature, round(median(prev_MP), 6) as median from p
union all select 'prev_G', round(median(prev_G), 6) from p
union all select 'MP', round(median(MP), 6) from p
""")
def q_ml1b(spark, sf):
    p = _udn_prev(spark, sf)
    return rounded(ML.median_table(p, ["prev_MP", "prev_G", "MP"]))


@register("scale_table", f"""
with {UDN}, u as (unpivot (select cast(G as double) as G, cast(GS as double) as GS, MP from udn) on G, GS, MP into name feature value v)
select feature, round(avg(v), 6) as mean,
  round(case when coalesce(stddev_pop(v), 0) = 0 then 1.0 else stddev_pop(v) end, 6) as scale from u group by feature
""")
def q_ml2(spark, sf):
    return rounded(ML.scale_table(_udn(spark, sf), ["G", "GS", "MP"]))


@register("class_weights", f"""
with {DL}, c as (select cast(coalesce(quality, 0) as integer) as y, count(*) as n_class from dl group by 1)
select y, n_class, round((select count(*) from dl) / (2.0 * n_class), 6) as weight from c
""")
def q_ml9(spark, sf):
    return rounded(ML.class_weights(doc_label(spark, sf), "quality"))


GIVEN_SCORES_SQL = f"""
{UD}, s as (
  select period as award, 'baseline' as family, entity, mp / 1000.0 as score from ud
  union all select period, 'tree', entity, cast(gs as double) / 10.0 from ud),
tops as (select award, family, max(score) as top1_score from s group by all),
ch as (select award, family, top1_score from (
  select *, row_number() over (partition by award order by top1_score desc, case family when 'baseline' then 0 else 1 end) as rn
  from tops) t where rn = 1)
"""


def _given_scores(spark, sf):
    # two candidate score columns per day, as two model families
    ud = _ud(spark, sf)
    a = ud.select(F.col("period").alias("award"), F.lit("baseline").alias("family"), "entity",
                  (F.col("mp") / 1000.0).alias("score"))
    b = ud.select(F.col("period").alias("award"), F.lit("tree").alias("family"), "entity",
                  (F.col("gs").cast("double") / 10.0).alias("score"))
    return a.unionByName(b)


@register("select_family", f"with {GIVEN_SCORES_SQL} select award, family, round(top1_score, 6) as top1_score from ch")
def q_ml12(spark, sf):
    return rounded(ST.select_family(_given_scores(spark, sf)))


@register("prediction_audit", f"""
with {GIVEN_SCORES_SQL}
select t.award, t.family, round(t.top1_score, 6) as top1_score, cast(t.family = ch.family as integer) as chosen,
  'asof=2024-01-30' as snapshot, 29 as period, '28-29' as season_label
from tops t left join ch using (award)
""")
def q_s12(spark, sf):
    sc = _given_scores(spark, sf)
    audit = WR.prediction_audit(sc, ST.select_family(sc), "asof=2024-01-30", 29)
    return rounded(audit.drop("built_on"))


@register("latest_runs", """
with r as (select o_orderkey, o_orderpriority as award, strftime(o_orderdate, '%Y%m%d_%H%M%S') as run_id from orders),
m as (select award, max(run_id) as newest from r where regexp_full_match(run_id, '\\d{8}_\\d{6}') group by award)
select o_orderkey, award, run_id from r join m using (award) where run_id = newest
""")
def q_s5(spark, sf):
    # order dates as run ids, order priorities as the groups
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("award"),
                                          F.date_format("o_orderdate", "yyyyMMdd_HHmmss").alias("run_id"))
    return R.latest_runs(o, ["award"], "run_id")


# ---------------------------------------------------------------------------
# Fit-dependent queries (rows-only: solver output is not SQL)
# ---------------------------------------------------------------------------
FEATURES = ["pct_G", "pct_GS", "pct_MP"]


def _split_facts(spark, sf):
    t, _ = B.build_training_table(_facts(spark, sf), "mvp", "label", entity_col="Player", period_col="season")
    return W.temporal_split_last_k(t, "season", 3, 3)


def _small_grid():
    # one model per family (linear: L2 logistic regression; tree: a small random forest);
    # every model kind of the grid is exercised in tests/test_models.py
    return ML.model_grid(["logreg_l2", "rf"], rf={"num_trees": 30, "max_depth": 8})


@register("model_metrics_by_award")
def q_ml10(spark, sf):
    table_ = _split_facts(spark, sf)
    scored = ST.fit_on_split(table_, FEATURES, "label", "season", ["Player"], _small_grid(), award="mvp",
                             keep=["__row_id"])
    return rounded(M.metrics_by_award(scored, "season", "score", "label", ["Player"]))


@register("linear_coefficients")
def q_ml14(spark, sf):
    table_ = _split_facts(spark, sf)
    fm = ML.fit_model(table_.where(F.col("split") == "train"), FEATURES, "label", ML.model_grid(["logreg_l2"])[0])
    return rounded(ML.linear_coefficients(fm))


@register("predict_period")
def q_ml13(spark, sf):
    f = _facts(spark, sf)
    train, _ = B.build_training_table(f.where(F.col("season") < 29), "mvp", "label", entity_col="Player",
                                      period_col="season")
    specs = {s.family: s for s in ML.model_grid(["logreg_l2", "rf"], rf={"num_trees": 30, "max_depth": 8})}
    fams = {"baseline": ML.fit_model(train, FEATURES, "label", specs["linear"]),
            "tree": ML.fit_model(train, FEATURES, "label", specs["tree"])}
    out, choice = PR.predict_period(f.where(F.col("season") < 29).drop("__row_id"), f.where(F.col("season") == 29),
                                    29, {"mvp": fams})
    return rounded(out)


# ---------------------------------------------------------------------------
# Upstream steps, projections, reports
# ---------------------------------------------------------------------------
from ..operators import matching as U  # noqa: E402
from ..functions import names as N  # noqa: E402


@register("merge_sources", f"""
with {UD}, ev as (select user_id as entity, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as integer) as period,
                         count(*) filter (where event_type = 'click') as clicks, round(max(value), 6) as max_value
                  from events group by 1, 2)
select ud.entity, ud.period, ud.mp, ev.clicks as ev_clicks, ev.max_value as ev_max_value
from ud left join ev on ud.entity = ev.entity and ud.period = ev.period
""")
def q_u2(spark, sf):
    ev = table(spark, sf, "events")
    src = ev.groupBy(F.col("user_id").alias("entity"),
                     F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("period")).agg(
        F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"),
        F.round(F.max("value"), 6).alias("max_value"))
    base = _ud(spark, sf).select("entity", "period", "mp")
    return U.merge_sources(base, {"ev_": src}, ["entity", "period"])


NORM_L = "trim(regexp_replace(strip_accents(lower(trim(replace(c_name, 'Customer#', 'Supplier ')))), '[^a-z0-9]+', ' ', 'g'))"
NORM_R = "trim(regexp_replace(strip_accents(lower(trim(s_name))), '[^a-z0-9]+', ' ', 'g'))"
MATCH_BASE_SQL = f"""
l as (select c_custkey as left_id, c_name as left_name, {NORM_L} as key from customer),
r as (select s_suppkey as right_id, s_name as right_name, {NORM_R} as rkey from supplier),
rb as (select rkey, min(right_id) as right_id from r where rkey != '' group by rkey),
rb2 as (select rb.rkey, rb.right_id, r.right_name from rb join r on rb.right_id = r.right_id and rb.rkey = r.rkey)
"""


def _match(spark, sf, max_distance):
    # customer names re-spelled with the supplier prefix: numbers shared by both tables match
    c = table(spark, sf, "customer").select(
        "c_custkey", F.regexp_replace("c_name", "Customer#", "Supplier ").alias("c_name"))
    s = table(spark, sf, "supplier")
    m = U.entity_match(c, s, "c_name", "s_name", "c_custkey", "s_suppkey", max_distance)
    orig = table(spark, sf, "customer").select(F.col("c_custkey").alias("left_id"), F.col("c_name").alias("__raw"))
    return m.join(orig, "left_id").select("left_id", F.col("__raw").alias("left_name"), "key", "right_id",
                                          "right_name", "distance")


@register("entity_match", f"""
with {MATCH_BASE_SQL}
select l.left_id, l.left_name, l.key, rb2.right_id, rb2.right_name,
       case when rb2.right_id is not null then 0 end as distance
from l left join rb2 on l.key = rb2.rkey
""")
def q_u1(spark, sf):
    return _match(spark, sf, 0)


@register("entity_match_fuzzy", f"""
with {MATCH_BASE_SQL},
lk as (select distinct key from l where key != ''),
pairs as (select lk.key, rb2.right_id, levenshtein(lk.key, rb2.rkey) as d from lk, rb2),
best as (select key, min(d) as d from pairs where d <= 1 group by key),
pick as (select p.key, p.d, min(p.right_id) as right_id from pairs p join best b on p.key = b.key and p.d = b.d
         group by p.key, p.d)
select l.left_id, l.left_name, l.key, pick.right_id, rb2.right_name, cast(pick.d as integer) as distance
from l left join pick on l.key = pick.key left join rb2 on pick.right_id = rb2.right_id
""")
def q_u1_fuzzy(spark, sf):
    # oracle: every (name, supplier) pair scored by DuckDB -- brute force on the check tables
    return _match(spark, sf, 1)


@register("normalize_importance", f"""
with {UDN}, c as (
  select 'G' as name, corr(cast(G as double), label) as coefficient from udn
  union all select 'GS', corr(cast(GS as double), label) from udn
  union all select 'MP', corr(MP, label) from udn)
select name as feature, round(coefficient, 6) as value, cast(null as double) as std, round(abs(coefficient), 6) as abs_value from c
""")
def q_p16(spark, sf):
    fl = L.feature_label_corr(_udn(spark, sf), "label", ["G", "GS", "MP"])
    return rounded(P.normalize_importance(fl.select(F.col("feature").alias("name"), F.col("corr").alias("coefficient"))))


@register("select_features", f"""
with {FACTS_SQL} select Player, season, round(pct_G, 6) as pct_G, round(pct_GS, 6) as pct_GS, round(pct_MP, 6) as pct_MP from facts
""")
def q_f2(spark, sf):
    f = _facts(spark, sf).withColumn("pct_is_mvp_winner", F.col("label").cast("double"))
    # the label-derived pct_is_mvp_winner column is a leak by name and is not selected
    return rounded(P.select_features(f, N.infer_percentile_cols, keep=["Player", "season"]))


@register("leakage_report", f"""
with {UDN}, x as (select *, cast(label as double) as label_copy from udn),
c as (select 'G' as feature, corr(cast(G as double), label) as corr, count(G) as n, stddev_samp(G) as s from x
      union all select 'MP', corr(MP, label), count(MP), stddev_samp(MP) from x
      union all select 'label_copy', corr(label_copy, label), count(label_copy), stddev_samp(label_copy) from x
      union all select 'mvp_share', corr(MP, label), count(MP), stddev_samp(MP) from x)
select 'name' as kind, 'mvp_share' as feature, cast(null as double) as corr
union all select 'name', 'label_copy', cast(null as double)
union all select 'corr', feature, round(corr, 6) from c where n >= 25 and s > 1e-12 and abs(corr) >= 0.95
""")
def q_l3(spark, sf):
    x = (_udn(spark, sf).withColumn("label_copy", F.col("label").cast("double"))
         .withColumn("mvp_share", F.col("MP")).select("G", "MP", "label_copy", "mvp_share", "label"))
    return rounded(L.leakage_report(x, "label", "mvp"))


_AUDITED = {"Player": "bigint", "season": "int", "G": "bigint", "GS": "bigint", "MP": "double", "PTS": "double",
            "label": "int", "is_rookie": "int", "__row_id": "bigint", "pct_G": "double", "pct_GS": "double",
            "pct_MP": "double", "empty_stat": "double"}


@register("feature_audit", f"""
with {FACTS_SQL}, f as (select *, cast(null as double) as empty_stat from facts)
{" union all ".join(f"""select '{c}' as "column", '{t}' as type, false as is_text, false as is_list,
  count({c}) = 0 as all_null_numeric from f""" for c, t in _AUDITED.items())}
union all select 'teams_list', 'array<string>', false, true, false
""")
def q_f9(spark, sf):
    f = _facts(spark, sf).withColumn("empty_stat", F.lit(None).cast("double")).withColumn(
        "teams_list", F.array(F.lit("a")))
    return P.feature_audit(f)


@register("to_number", """
select o_orderkey, try_cast(o_orderpriority as double) as priority_number,
       try_cast(substr(o_orderpriority, 1, 1) as double) as priority_level,
       try_cast(o_orderstatus as double) as status_number from orders
""")
def q_p1(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", S.to_number("o_orderpriority").alias("priority_number"),
                    S.to_number(F.substring("o_orderpriority", 1, 1)).alias("priority_level"),
                    S.to_number("o_orderstatus").alias("status_number"))


@register("align_features", f"""
with {DL} select doc_id, round(n_words, 6) as n_words, cast(0.0 as double) as missing_feature, round(digit_share, 6) as digit_share from dl
""")
def q_p11(spark, sf):
    # the model's columns in its order: a missing training column becomes 0.0, extras are dropped
    d = P.select_numeric(doc_label(spark, sf))
    return rounded(P.align_features(d, ["n_words", "missing_feature", "digit_share"], keep=["doc_id"]))


@register("inf_to_null", """
select o_orderkey,
  cast(case when isinf(exp(o_totalprice / 100)) or isnan(exp(o_totalprice / 100)) then null
            else exp(o_totalprice / 100) end is not null as integer) as is_finite,
  round(o_totalprice, 6) as price from orders
""")
def q_p12(spark, sf):
    # exp overflows to +infinity for most prices / 100 (above ~709.78): those become NULL
    o = table(spark, sf, "orders")
    v = S.inf_to_null(F.exp(F.col("o_totalprice") / 100))
    return rounded(o.select("o_orderkey", v.isNotNull().cast("int").alias("is_finite"),
                            F.col("o_totalprice").alias("price")))


# ---------------------------------------------------------------------------
# Model studies (rows-only): each fit is a Spark job set over the full training rows
# ---------------------------------------------------------------------------
def _train_val(spark, sf):
    t = _split_facts(spark, sf)
    return t, t.where(F.col("split") == "train"), t.where(F.col("split") == "val")


@register("permutation_importance")
def q_ml15(spark, sf):
    t, train, _ = _train_val(spark, sf)
    fm = ML.fit_model(train, FEATURES, "label", ML.logreg_l2())
    return rounded(ST.permutation_importance(fm, t.where(F.col("split") == "val"), "label", "__row_id"))


@register("hparam_sweep")
def q_ml16(spark, sf):
    _, train, val = _train_val(spark, sf)
    return rounded(ST.hparam_sweep(train, val, FEATURES, "label", award="mvp"))


@register("feature_ablation")
def q_ml17(spark, sf):
    t, _, _ = _train_val(spark, sf)
    # groups by name: games (pct_G, pct_GS) and minutes (pct_MP)
    return rounded(ST.feature_ablation(t, FEATURES, "label", ML.logreg_l2(),
                                       groups={"games": [r"_GS?$"], "minutes": [r"_MP$"]}))


@register("learning_curve")
def q_ml18(spark, sf):
    t, _, val = _train_val(spark, sf)
    train_part = t.where(F.col("split") == "train")
    return rounded(ST.learning_curve(train_part, FEATURES, "label", "season", val, ML.logreg_l2()))


@register("walk_forward_statistics", f"""
with {UDN}, p as (select Player, season, MP, lag(MP) over w as prev_MP, cast(lag(G) over w as double) as prev_G from udn
                  window w as (partition by Player order by season)),
long as (select season, 'MP' as feature, MP as v from p union all select season, 'prev_MP', prev_MP from p
         union all select season, 'prev_G', prev_G from p),
cuts as (select distinct season as cut from p where season > 1),
part as (select c.cut, l.feature, l.v from cuts c join long l on l.season < c.cut),
med as (select cut, feature, count(*) as n_rows, count(v) as n_values, median(v) as median from part group by cut, feature)
select m.cut, m.feature, m.n_rows, m.n_values, round(m.median, 6) as median, round(avg(coalesce(v, m.median)), 6) as mean,
  round(case when max(coalesce(v, m.median)) = min(coalesce(v, m.median)) then 1.0
             when m.median is not null then stddev_pop(coalesce(v, m.median)) end, 6) as scale
from part join med m on part.cut = m.cut and part.feature = m.feature
group by m.cut, m.feature, m.n_rows, m.n_values, m.median
""")
def q_ml1_folds(spark, sf):
    # what the imputers and scalers of all walk-forward folds need, in one plan
    p = _udn_prev(spark, sf)
    cuts = [r[0] for r in p.where("season > 1").select("season").distinct().collect()]  # one row per season
    return rounded(PX.prefix_statistics(p, ["MP", "prev_MP", "prev_G"], "season", cuts))


@register("volume_fit_by_split")
def q_volume_fit(spark, sf):
    # volume percentiles and flag beside the features, unweighted logistic regression, quality of each split
    t = W.add_volume_features(_split_facts(spark, sf).join(
        _udn(spark, sf).select("Player", "season", "G", "GS", "MP"), ["Player", "season"]), "season", "mvp")
    feats = [*FEATURES, "G_vol_pct", "GS_vol_pct", "MP_vol_pct", "low_volume_flag"]
    scored = ST.fit_on_split(t, feats, "label", "season", ["Player"], [ML.logreg_unweighted()], award="mvp")
    return rounded(ST.split_quality(scored, "season", "score", "label", ["Player"]))


@register("rolling_eval")
def q_ml19(spark, sf):
    t, _, _ = _train_val(spark, sf)
    ranks, summary = ST.rolling_eval(t, FEATURES, "label", "season", ["Player"], ML.logreg_l2())
    return rounded(summary)


from . import io_queries  # noqa: E402,F401  registers the queries of sources, sinks and builders
