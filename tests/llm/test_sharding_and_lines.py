import random
import zlib

import pytest
from pyspark.sql import functions as F

from podium.llm import line_dedup, sharding
from podium.llm.common import connected_components

from . import brute

DOCS = "doc_id long, text string, source string, size string, shard string"


def _shards(spark, rows, k=4, schema=DOCS):
    df = spark.createDataFrame(rows, schema)
    body = F.coalesce(F.col("text"), F.lit(""))
    out = sharding.contiguous_shards(df, k, F.octet_length(body).cast("long") + 8, "doc_id",
                                     {"crc": F.crc32(F.encode(body, "UTF-8"))}, rows_per_block=7)
    return sorted((r.shard, r.slot, r.doc_id, r.size, r.crc) for r in out.collect())


def test_shards_follow_the_prefix_sums(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.choice([0, 1, 30, 400]) if i % 7 else None, "s", "x", "y") for i in range(200)]
    rng.shuffle(rows)
    got = _shards(spark, rows, 24)
    rows.sort()
    sizes = [len((r[1] or "").encode()) + 8 for r in rows]
    want = brute.shards(sizes, 24)
    assert [g[2] for g in got] == [r[0] for r in rows]
    assert [g[0] for g in got] == want
    assert [g[3] for g in got] == sizes
    assert [g[4] for g in got] == [zlib.crc32((r[1] or "").encode()) for r in rows]
    seen = {}
    for shard, slot, *_ in got:
        assert slot == seen.get(shard, 0)
        seen[shard] = slot + 1


def test_shards_of_ties_nulls_and_nothing(spark):
    assert _shards(spark, []) == []
    got = _shards(spark, [(None, "a", "s", "", "")] * 3 + [(5, None, None, None, None)] * 3)
    assert [g[2] for g in got] == [None] * 3 + [5] * 3
    assert [g[0] for g in got] == brute.shards([9] * 3 + [8] * 3, 4)
    zero = sharding.contiguous_shards(spark.createDataFrame([(1,), (2,)], "k long"), 3, F.lit(0), "k").collect()
    assert {r.shard for r in zero} == {0}


@pytest.mark.parametrize("copies_once", [False, True])
def test_line_dedup_matches_brute_force(spark, copies_once):
    rng = random.Random(2)
    rows = []
    for i in range(150):
        lines = [f"line {rng.randrange(400)} of text" for _ in range(rng.randrange(4))]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines) + 1), "Home | About | Contact")
        if rng.random() < 0.5:
            lines += ["", "  "]
        rows.append((i, "\n".join(lines), rng.choice(["a", "a", "a", "b", None]), "n", "t"))
    rows += [(500, None, "a", None, None), (None, "Home | About | Contact", "a", "", ""), (7, rows[7][1], "a", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines string, drop string")
    got = line_dedup.drop_boilerplate(df, min_pages=5, copies_once=copies_once)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or "")
    want = brute.drop_lines([(r[2], r[1]) for r in rows], least=5, copies_once=copies_once)
    assert any(w != r[1] for w, r in zip(want, rows))
    have = sorted(((r.doc_id, r.row.text, r.host, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=key)
    full = sorted(((r[0], r[1], r[2], 0 if r[1] is None else r[1].count("\n") + 1, w) for r, w in zip(rows, want)), key=key)
    assert [h[:4] for h in have] == [f[:4] for f in full]
    assert [h[5] for h in have] == [f[4] for f in full]
    for h in have:
        if h[5]:
            assert h[4] == h[3] - (h[5].count("\n") + 1)


def test_line_dedup_keeps_small_sites_and_copies(spark):
    rows = [(i, "same page\nsame text", "a") for i in range(50)] + [(99, "alone", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.n_dropped for r in line_dedup.drop_boilerplate(df, copies_once=True).collect()} == {0}
    # as pages of their own, copies are over the ratio on every line
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.drop_boilerplate(df).collect()}
    assert got == {i: (2, "") for i in range(50)} | {99: (0, "alone")}
    assert line_dedup.drop_boilerplate(df.limit(0)).collect() == []


def test_line_dedup_of_very_long_texts(spark):
    rng = random.Random(8)
    long = "\n".join(f"line {rng.randrange(10**9)} {i}" for i in range(400_000))  # about 10 MB
    rows = [(1, long + "\nfooter", "a"), (2, "x" * 10_000_000, "a"), (3, "own\nfooter", "a"), (4, "w\n" * 300_000, "b")]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(
        spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [(got[i].n_lines, got[i].n_dropped) for i in (1, 2, 3, 4)] == [(400_001, 1), (1, 0), (2, 1), (300_001, 0)]
    assert got[1].text == long and got[2].text == rows[1][1] and got[3].text == "own" and got[4].text == rows[3][1]


def test_components_of_a_chain_a_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    random.Random(3).shuffle(chain)
    edges = chain + [(1, i) for i in range(2, 30)] + [(50, 50)] + [(201, 200), (200, 201)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 30)} | {200: 200, 201: 200}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
