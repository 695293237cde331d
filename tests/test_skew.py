"""One value holding a third of all rows must not land in one task."""

from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.operators import ordering as O
from podium.operators import windows as W


def _skewed(spark, n=3000):
    # a third of the rows share score 0.5 in period 1; the rest are spread
    return spark.range(n).select(
        F.col("id").alias("rid"), F.lit(1).alias("p"),
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise((F.col("id") * 7919 % 1000) / 1000.0).alias("s"))


def test_hot_value_is_split_across_blocks(spark):
    rows = _skewed(spark).select("rid", "s")
    blocks = O.in_blocks(rows, [F.col("s").desc_nulls_last(), F.col("rid").asc()], 10)
    sizes = [r["count"] for r in blocks.groupBy("b").count().collect()]
    # the 1,000 tied rows are cut by the row key: no block holds them all
    assert len(sizes) >= 9 and max(sizes) <= 3 * 300
    # the number is on disk: reading again gives the same blocks
    assert blocks.exceptAll(blocks.orderBy(F.rand(3)).repartition(7)).isEmpty()


def test_full_blocks_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BLOCK", 50)
    blocks = O.in_blocks(_skewed(spark), [F.col("s").asc(), F.col("rid").asc()])
    assert blocks.select("b").distinct().count() >= 50 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = W.rank_in_period(_skewed(spark), "p", "s", ["rid"])
    assert got.select("rank").distinct().count() == 3000


def test_helper_columns_give_way_to_the_callers(spark):
    df = spark.range(20).select((F.col("id") % 2).alias("p"), F.col("id").cast("double").alias("x"),
                                F.col("id").alias("__spread"), F.lit("a").alias("__salt"), F.lit(None).alias("__one"),
                                F.col("id").alias("cum___one"))
    z = W.group_zscore(df, "p", ["x"])
    assert z.columns == [*df.columns, "x_z"] and z.agg(F.sum("__spread")).first()[0] == 190
    ranked = W.rank_in_period(df, "p", "x", ["__spread"])
    assert ranked.columns == [*df.columns, "rank"] and ranked.agg(F.sum("cum___one")).first()[0] == 190
    pct = W.percent_rank_avg(df, "p", ["x", "__one"])
    assert pct.where("__one_pct is not null").isEmpty() and pct.where("x_pct = 1").count() == 2


def test_ranks_exact_under_skew(spark, distributed):
    df = _skewed(spark)
    got = W.rank_in_period(df, "p", "s", ["rid"])
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("p").orderBy(F.col("s").desc(), "rid")))
    j = got.join(ref.select("rid", "ref"), "rid")
    assert j.where(F.col("rank") != F.col("ref")).count() == 0
    pct = {r.rid: r.s_pct for r in W.percent_rank_avg(df, "p", "s").where("rid < 3").collect()}
    # rid 0 holds the hot value 0.5: 1,000 ties share the average rank
    below, ties = df.where("s < 0.5").count(), df.where("s = 0.5").count()
    assert ties >= 1000
    assert abs(pct[0] - (below + (ties + 1) / 2.0) / 3000.0) < 1e-12


def test_any_type_and_any_column_name(spark, distributed):
    """A group called p, a text score, longs beyond 2**53, names the plan uses itself."""
    rows = [("a", "x" + str(i % 7), 2**53 + i % 3, i, None if i % 5 == 0 else float(i)) for i in range(60)]
    rows += [("b", None, 2**53, 100, 1.0), (None, "z", None, 101, 2.0)]
    df = spark.createDataFrame(rows, "p string, b string, g long, n long, row double")
    got = {r.n: r["rank"] for r in W.rank_in_period(df, "p", "b", ["n"]).collect()}
    ref = df.withColumn("r", F.when(F.col("b").isNotNull(), F.row_number().over(
        Window.partitionBy("p").orderBy(F.col("b").desc_nulls_last(), "n"))))
    assert got == {r.n: r.r for r in ref.collect()}
    for c in ("b", "g", "row"):
        pct = {r.n: r[f"{c}_pct"] for r in W.percent_rank_avg(df, "p", c).collect()}
        every = [r for r in rows if r[0] == "a"]
        at = df.columns.index(c)
        known = [r[at] for r in every if r[at] is not None]
        for r in every:
            want = None if r[at] is None else (sum(v < r[at] for v in known) + (sum(v == r[at] for v in known) + 1) / 2) / len(known)
            assert pct[r[3]] == want if want is None else abs(pct[r[3]] - want) < 1e-12
    q = {r.p: (r.q0, r.n) for r in O.exact_quantiles(df.select("p", F.col("row").alias("v")), ["p"], "v", [0.5]).collect()}
    import statistics
    assert q["a"] == (statistics.median(r[4] for r in rows if r[0] == "a" and r[4] is not None), 48)
    assert q[None] == (2.0, 1)


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_few_exchanges_whatever_the_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    ranked = W.rank_in_period(df.select("l_orderkey", "l_linenumber", "l_returnflag", "l_tax"), "l_returnflag", "l_tax",
                              ["l_orderkey", "l_linenumber"])
    assert _exchanges(ranked) <= 6
    one = W.percent_rank_avg(df, "l_returnflag", ["l_tax"])
    four = W.percent_rank_avg(df, "l_returnflag", ["l_tax", "l_discount", "l_quantity", "l_linenumber"])
    assert _exchanges(one) == _exchanges(four) <= 10
    assert "NestedLoop" not in four._jdf.queryExecution().executedPlan().toString()


def test_percentiles_of_ties_over_many_blocks(spark):
    """One value in half the rows, runs that fill whole blocks, nulls and repeated rows."""
    rows = [(i % 2, 7.0 if i % 4 < 2 else float(i // 40), None if i % 5 == 0 else i % 3) for i in range(600)]
    df = spark.createDataFrame(rows + rows[:20], "p int, x double, y int")
    import pandas as pd
    pdf = df.toPandas()
    want = pdf.assign(a=pdf.groupby("p").x.rank(pct=True), b=pdf.groupby("p").y.rank(pct=True))
    for blocks in (1, 2, 7, 64):
        got = W.percent_rank_avg(df, "p", ["x", "y"], names=["a", "b"], blocks=blocks).toPandas()
        assert len(got) == 620
        for c in "ab":
            assert sorted(got[c].dropna().round(9)) == sorted(want[c].dropna().round(9)), (blocks, c)
        keyed = got.groupby(["p", "x"]).a.nunique()
        assert keyed.max() == 1


def test_facts_are_not_shuffled_by_period(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from podium.operators import metrics as M
        df = _skewed(spark).withColumn("label", (F.col("rid") == 7).cast("int"))
        plans = [M.winner_ranks(df, "p", "s", "label", ["rid"]), W.group_zscore(df, "p", ["s"]),
                 W.walk_forward_folds(df, "p", "label"), W.learning_curve_folds(df, "p", "label")]
        for out in plans[:2]:
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "__spread" in plan or "__salt" in plan
        for out in plans:
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
        seven = df.where("rid = 7").first()
        ahead = df.where((F.col("s") > seven.s) | ((F.col("s") == seven.s) & (F.col("rid") < 7))).count()
        assert plans[0].first()["winner_rank"] == ahead + 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("conf", [{}, {"spark.sql.autoBroadcastJoinThreshold": "-1"},
                                  {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}])
def test_blocks_agree_beyond_the_sampled_keys(spark, conf):
    """Bounds come from a sample of far fewer rows than these: both sides of the plan
    must still see the same blocks, whatever columns the caller keeps, cached or not."""
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(200_000).select(F.col("id").alias("rid"), (F.col("id") % 3).alias("p"),
                                         F.pmod(F.xxhash64("id"), F.lit(50_000)).alias("s"), F.lit("wide").alias("w")).cache()
        ranked = W.rank_in_period(df, "p", "s", ["rid"])
        assert ranked.where("rank <= 5").select("rid", "rank").count() == 15
        assert ranked.groupBy("p").agg(F.max("rank").alias("m"), F.count("rank").alias("n")).where("m <> n").count() == 0
        got = {r.p: r.q0 for r in O.exact_quantiles(df, ["p"], "s", [0.5]).collect()}
        want = {r.p: r.q for r in df.groupBy("p").agg(F.percentile("s", 0.5).alias("q")).collect()}
        assert got == want
        df.unpersist()
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_time_split_computes_its_table_once(spark):
    # each computed row counts; the check of the periods, the ranking and the split read the table
    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    rows = spark.sparkContext.parallelize([(i, i % 9) for i in range(90)], 3).map(counted)
    df = spark.createDataFrame(rows, "entity long, period long")
    got = W.temporal_split_last_k(df, "period", 2, 2)
    parts = {(r.period, r.split) for r in got.collect()}
    assert parts == {(p, "train" if p < 5 else "val" if p < 7 else "test") for p in range(9)}
    assert got.count() == 90
    assert seen.value == 90


@pytest.mark.parametrize("blocks", [1, 4, 40])
def test_runs_of_equal_values_over_many_blocks(spark, blocks):
    # a run of a thousand ties, blocks of one value, of two and of many
    values = [1.0] * 500 + [2.0] * 1000 + [float(i) for i in range(3, 300)] + [None] * 5
    df = spark.createDataFrame([(i % 2, i, v) for i, v in enumerate(values * 2)], "g long, id long, v double")
    got = O.average_ranks(df, ["g"], F.col("v"), blocks=blocks).collect()
    assert len(got) == 2 * (len(values) - 5)
    for g in (0, 1):
        mine = sorted(v for i, v in enumerate(values * 2) if i % 2 == g and v is not None)
        for r in got:
            if r.g == g:
                assert (r._before, r._through, r._total) == (bisect_left(mine, r.v), bisect_right(mine, r.v), len(mine))
