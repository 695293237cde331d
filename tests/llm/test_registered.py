import __spark_entry__
import pytest
from podium.llm import queries


def test_every_operator_has_one_query():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in __spark_entry__.queries()
    assert set(queries.ORACLE) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", ["op2_warc", "op5_line_dedup", "op9_decontamination"])
def test_queries_match_their_sql(spark, name):
    import duckdb
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, sf)
    with duckdb.connect() as c:
        for t in ("documents", "pages", "benchmark"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = c.execute(queries.ORACLE[name])
        columns = [d[0] for d in want.description]
        rows = want.fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, rows))


def test_short_benchmark_items_match_their_sql(spark, tmp_path):
    import duckdb
    docs = [(1, "alpha beta gamma delta"), (2, "Beta, gamma!"), (3, "gamma beta"), (4, "zeta"), (5, None), (6, ""),
            (7, "one two three four five six seven eight"), (8, "one two three four five SIX"), (9, "delta eta theta")]
    items = [(10, "beta gamma"), (11, "zeta"), (12, "eta theta iota"), (13, "delta Eta theta"), (14, None), (15, "!"),
             (16, "one two X four five six")]
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = queries.QUERIES["op9_decontamination"](spark, str(tmp_path))
    with duckdb.connect() as c:
        for t in ("documents", "benchmark"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        want = c.execute(queries.ORACLE["op9_decontamination"])
        columns = [d[0] for d in want.description]
        rows = want.fetchall()
    found = sorted(tuple(r) for r in got.select(*columns).collect())
    assert found == sorted(rows)
    assert {r.doc_id: r.item_id for r in got.where("contaminated").collect()} == {1: 10, 2: 10, 4: 11, 7: 16, 8: 16, 9: 13}
