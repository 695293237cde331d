import random

import corpus_pipeline
from podium.llm import packing

from . import brute


def _corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("aeioulmnrst", k=rng.randrange(2, 8))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, prose(30)) for i in range(10)]
    docs = []
    for i in range(120):
        lines = [prose(rng.randrange(30, 60)) for _ in range(rng.randrange(1, 4))]
        if i % 4 == 0:
            lines.append("Home About Contact")
        if i % 10 == 3:
            lines.append(rng.choice(items)[1])
        if i % 10 == 5:
            lines = [" ".join(w + "%%%" for w in lines[0].split())]
        docs.append((i, "\n".join(lines)))
    docs += [(200 + k, docs[k][1]) for k in range(0, 40, 4)]
    docs += [(300 + k, docs[k][1].replace(" ", "  ", 3)) for k in range(1, 40, 4)]
    docs += [(400, None), (401, ""), (None, prose(50)), (402, "short text")]
    rows = [(i, t, "en", f"s{(i or 0) % 3 if i != 402 else 9}", len(t or ""), "extra", "mine") for i, t in docs]
    labels = [(i, 0 if i % 10 == 5 else 1, 0) for i in range(0, 120, 2)] + [(5, 0, 0)]
    return rows, labels, items


def _brute(rows, labels, items):
    trusted = {i for i, q, _ in labels if q == 1}
    kept = brute.quality_kept([(r[0], r[1]) for r in rows], trusted)
    rows = [r for r in rows if kept[r[0]][1]]
    rows = [(*r[:1], t, *r[2:]) for r, t in zip(rows, brute.drop_lines([(r[3], r[1]) for r in rows], copies_once=True))]
    comp = brute.components([r[0] for r in rows], [brute.fingerprint(r[1]) for r in rows])
    best = {}
    for r, c in zip(rows, comp):
        key = c if c is not None else ("none", brute.fingerprint(r[1]))
        if key not in best or (r[0] is None, r[0] or 0) < (best[key][0] is None, best[key][0] or 0):
            best[key] = r
    return [r for r in best.values() if not brute.leak(r[1], items)]


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, labels, items = _corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `row` string, `__h` string"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name.replace(" ", "-"))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "__h"]
    want = _brute(rows, labels, items)
    got = [tuple(r) for r in docs.collect()]
    assert sorted(((r[0], r[1]) for r in got), key=str) == sorted(((r[0], r[1]) for r in want), key=str)
    assert all(r[4] == len(r[1]) and r[5:] == ("extra", "mine") for r in got)
    assert 0 < len(got) < len(rows) - 20
    packed = corpus_pipeline.run(spark, sf).collect()
    assert sorted((str(r.doc_id) for r in packed if r.piece == 0)) == sorted(str(r[0]) for r in want)
    length = {}
    for r in packed:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    assert length == {r[0]: len(r[1].split()) + 1 for r in want}
    room = {}
    for r in packed:
        room[r.bin] = room.get(r.bin, 0) + r.length
    assert max(room.values()) <= packing.CAPACITY


def test_stages_keep_going_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
