import random

import duckdb
from pyspark.sql import functions as F

from podium.llm import decontaminate, quality, queries

from . import brute

SCHEMA = "doc_id long, text string, row string, n_words string"


def _corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("aeioulmnrst", k=rng.randrange(2, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n)) + "."

    rows = []
    for i in range(160):
        kind = rng.random()
        if kind < 0.6:
            t = "\n".join(prose(rng.randrange(5, 40)) for _ in range(rng.randrange(1, 5)))
        elif kind < 0.75:
            t = " ".join(w + rng.choice(["%%%", "***", "###"]) for w in rng.choices(vocabulary, k=60))
        elif kind < 0.85:
            line = prose(rng.randrange(6, 14))
            t = "\n".join([line] * rng.randrange(1, 6) + [prose(30)])
        elif kind < 0.95:
            t = " ".join(w for w in rng.choices(vocabulary, k=8) for _ in range(rng.randrange(1, 14)))
        else:
            t = prose(rng.randrange(25))
        rows.append((i, t))
    return rows + [(900, None), (901, ""), (902, " \n\x0b "), (903, "É x\xa0y " * 30), (None, rows[0][1]), (0, rows[0][1])]


def test_base_rules_and_verdicts_match_brute_force(spark):
    rows = _corpus()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    trusted = {i for i, t in rows if i is not None and t and not any(c in t for c in "%*#")}
    ids = spark.createDataFrame([(i,) for i in trusted] + [(None,)], "doc_id long")
    got = quality.quality_verdicts(df, ids).collect()
    assert len(got) == len(rows)
    want = brute.quality_kept(rows, trusted)
    kept = set()
    for r in got:
        base = brute.base_rules(r.row.text)
        assert {k: r[k] for k in base} == base, r
        mean, keep = want[r.row.doc_id]
        assert (r.llr_micro is None) == (mean is None) and (mean is None or abs(r.llr_micro - mean) <= 1)
        if mean is None or abs(mean - quality.THRESHOLD * quality.MICRO) > 1:
            assert r.kept == keep
        kept.add(r.kept)
    assert kept == {True, False}
    # a filter on the verdict gives the same rows
    assert quality.quality_verdicts(df, ids).where("kept").count() == sum(r.kept for r in got)


def test_quality_without_trusted_rows_and_without_rows(spark):
    df = spark.createDataFrame([(1, "word " * 3 + " ".join(map(str, range(40))), "", ""), (2, "short", "", "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long")
    assert {r.row.doc_id: (r.llr_micro, r.kept) for r in quality.quality_verdicts(df, none).collect()} == {
        1: (0, True), 2: (0, False)}
    assert quality.quality_verdicts(df.limit(0), none).collect() == []


def _leak_corpus():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([8, 9, 12, 13, 30, 50])))) for i in range(25)]
    items += [(40, items[3][1]), (41, None), (42, ""), (43, "of of of of of of of of of of of of of of")]
    docs = []
    for i in range(120):
        w = rng.choices(vocabulary, k=rng.randrange(80))
        if i % 2:
            item = rng.choice(items[:25])[1].split(" ")
            for _ in range(rng.randrange(5)):
                item[rng.randrange(len(item))] = "changed"
            lo = rng.randrange(len(item)) if rng.random() < 0.3 else 0
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() if rng.random() < 0.2 else x for x in item[lo:]]
        docs.append((i, rng.choice([" ", ", ", " - "]).join(w)))
    every_fifth = items[4 if len(items[4][1].split()) > 20 else 0][1].split(" ")
    docs.append((500, " ".join("x" if k % 5 == 4 else x for k, x in enumerate(every_fifth))))
    docs += [(501, None), (502, ""), (None, max((x for _, x in items[:25]), key=len) + " tail"), (503, "of " * 40)]
    return docs, items


def test_leaks_match_brute_force_and_sql(spark):
    docs, items = _leak_corpus()
    df = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id long, text string, item_id string, seed string")
    bench = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, context string")
    got = {r.doc_id: (r.item_id, r.matched) for r in decontaminate.leaks(df, bench).collect()}
    want = {i: brute.leak(t, [x for x in items if x[1]]) for i, t in docs}
    assert got == {i: x for i, x in want.items() if x}
    assert 30 < len(got) < len(docs) - 30 and None in got
    # blocks of few seeds give the same
    blocks = {r.doc_id: (r.item_id, r.matched) for r in decontaminate.leaks(df, bench, seeds_per_block=700).collect()}
    assert blocks == got
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in got)

    with duckdb.connect() as c:
        c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        c.executemany("INSERT INTO documents VALUES (?, ?)", [d for d in docs if d[0] is not None])
        c.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
        c.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
        rows = c.execute(queries.OP9_SQL).fetchall()
    assert {r[0]: r[2:] for r in rows if r[1]} == {i: x for i, x in got.items() if i is not None}


def test_leaks_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "some item of the benchmark that is long enough to have seeds")], "item_id long, text string")
    assert decontaminate.leaks(docs.limit(0), bench).collect() == []
    assert decontaminate.leaks(docs, bench.limit(0)).collect() == []
    assert decontaminate.drop_leaks(docs, bench.where(F.lit(False))).count() == 1
