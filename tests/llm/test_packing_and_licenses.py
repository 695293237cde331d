import random

from podium.llm import licenses, packing
from podium.llm.license_texts import TEMPLATES


def _plain_best_fit(lengths, labels, capacity):
    bins, out = [], []
    for n, (a, b) in zip(lengths, labels):
        fits = [(cap, age) for age, (cap, has, _) in enumerate(bins)
                if cap >= n and not ({("a", a), ("b", b)} - {("a", None), ("b", None)}) & has]
        if fits:
            tightest = min(c for c, _ in fits)
            i = min((x for x in fits if x[0] == tightest), key=lambda x: bins[x[1]][2])[1]
        else:
            bins.append([capacity, set(), 0])
            i = len(bins) - 1
        out.append((i, capacity - bins[i][0]))
        bins[i][0] -= n
        bins[i][1] |= {("a", a), ("b", b)} - {("a", None), ("b", None)}
        bins[i][2] = len(out)  # of equally tight bins, the one left alone longest
    return out


def test_bins_match_a_plain_search():
    rng = random.Random(1)
    for capacity in (10, 31, 64):
        lengths = sorted((rng.randint(1, capacity) for _ in range(400)), reverse=True)
        labels = [(rng.choice([None, *"sstuv"]), rng.choice([None] * 5 + [*"xy"])) for _ in lengths]
        assert packing.pack_group(lengths, labels, capacity) == _plain_best_fit(lengths, labels, capacity)


def test_packing_keeps_every_piece_and_no_conflict(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([0, 1, 5, 19, 40, 95]) + (str(i) if i % 3 else ""), rng.choice(["a", "a", "b", "c", None]),
             "p", "n") for i in range(300)]
    rows += [(1000, None, "a", "", ""), (None, "w w", None, "", ""), (5, rows[5][1], rows[5][2], "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, piece string, bin string")
    got = packing.best_fit(df, packing.word_length(), capacity=20, group_rows=50).collect()
    total = {}
    for i, t, *_ in rows:
        total[i] = total.get(i, 0) + len((t or "").split()) + 1
    have = {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.length
    assert have == total
    by_bin, text = {}, {r[0]: r for r in rows}
    for r in got:
        by_bin.setdefault(r.bin, []).append(r)
    for members in by_bin.values():
        members.sort(key=lambda r: r.offset)
        assert [r.offset for r in members] == [sum(x.length for x in members[:k]) for k in range(len(members))]
        assert sum(r.length for r in members) <= 20
        sources = [text[r.doc_id][2] for r in members if text[r.doc_id][2] is not None]
        texts = [text[r.doc_id][1] for r in members]
        assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)
    assert packing.best_fit(df.limit(0), packing.word_length()).collect() == []


def test_licenses_are_found_with_their_spans(spark):
    mit = " ".join(TEMPLATES["MIT"].split())
    edited = mit.replace("free of charge", "at no cost").replace("WITHOUT WARRANTY OF ANY KIND", "with no warranty at all")
    rows = [
        (1, "Some words. Licensed under the Apache License, Version 2.0. More words."),
        (2, "ÉÉ İ\n" + mit + "\nend"),
        (3, "intro " * 500 + edited),
        (4, "All rights reserved. All rights reserved."),
        (5, "the license of the software is not here, nor are rights granted"),
        (6, "licensed UNDER\nthe gnu; general public -- license version 3 this work is"),
        (7, None), (8, ""), (None, "Released under the MIT License."), (9, "all rights"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, license string, start string")
    got = sorted((r.doc_id or 0, r.license, r.start, r.end, r.matched, r.length)
                 for r in licenses.find_licenses(df).collect())
    text = {r[0] or 0: r[1] for r in rows}
    spans = [(d, name, text[d][a:b]) for d, name, a, b, *_ in got]
    assert (1, "Apache-2.0 notice", "Licensed under the Apache License, Version 2.0") in spans
    assert (2, "MIT", mit[:-1]) in spans
    assert [x[:2] for x in spans if x[0] == 3] == [(3, "MIT")]
    assert [x[2] for x in spans if x[0] == 4] == ["All rights reserved"] * 2
    assert (0, "MIT notice", "Released under the MIT License") in spans
    assert not [x for x in spans if x[0] in (5, 7, 8, 9)]
    edited_row = next(x for x in got if x[0] == 3)
    assert 0.8 * edited_row[5] <= edited_row[4] < edited_row[5]
    assert licenses.find_licenses(df.limit(0)).collect() == []


def test_every_template_finds_itself():
    index = licenses.TemplateIndex(TEMPLATES)
    for name, body in TEMPLATES.items():
        ids = [index.vocabulary.get(w, -1) for w in licenses.words("before it " + body + " after it")]
        import numpy as np
        found = licenses.scan(ids, index.hits(np.array(ids)).tolist(), index)
        n = len(licenses.words(body))
        assert (index.names.index(name), n, 2, 2 + n) in found
