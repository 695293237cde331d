"""Driver contract and invariances (input order, shuffle partitions, path)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from podium.operators import metrics as M
from podium.operators import windows as W
from podium.sources.tables import user_day


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.n_periods, r.hit_at_1, r.hit_at_5) == (30, 0.3, 0.8)
    assert r.mrr == pytest.approx(0.507012) and r.mean_winner_rank == pytest.approx(3.433333)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _flagship(spark, df):
    scored = W.percent_rank_avg(df, "period", "mp")
    return tuple(M.ranking_report(scored, "period", "mp_pct", "label", ["entity"]).first())


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_unchanged_by_shuffle_partitions_and_order(spark, parts):
    base = _flagship(spark, user_day(spark, "/root/testdata/sf0.01"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("podium.ordering.blocks", "31")
    try:
        shuffled = user_day(spark, "/root/testdata/sf0.01").orderBy(F.rand(7)).repartition(parts)
        assert _flagship(spark, shuffled) == pytest.approx(base)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("podium.ordering.blocks")
