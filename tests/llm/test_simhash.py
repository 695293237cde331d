import itertools
import random

import numpy as np

from podium.llm import simhash

from . import brute


def test_fingerprint_by_its_definition():
    rng = random.Random(1)
    texts = [None, "", " \t\n\x0b", "one", "one TWO", "É É é é é", "a\xa0b c d e f", "x " * 50_000]
    texts += ["".join(rng.choices("aBcÉ \n\t\x0b.", k=rng.randrange(300))) for _ in range(200)]
    for t in texts:
        assert simhash.fingerprint(t) == brute.fingerprint(t), repr(t)


def test_threshold_allocation_is_the_best():
    rng = random.Random(2)
    for m in (2, 3, 4, 5):
        costs = [[0.0, *sorted(rng.random() * 100 for _ in range(5))] for _ in range(m)]
        got = simhash.allocate(costs, 4)
        assert sum(got) == 4 - m + 1
        best = min(sum(row[t + 1] for row, t in zip(costs, ts))
                   for ts in itertools.product(range(-1, 5), repeat=m) if sum(ts) == 4 - m + 1)
        assert abs(sum(row[t + 1] for row, t in zip(costs, got)) - best) < 1e-9


def test_bits_that_go_together_share_a_partition():
    correlation = np.eye(64)
    for a, b in ((0, 40), (5, 63), (17, 33)):
        correlation[a, b] = correlation[b, a] = 0.9
    for m in (2, 3, 4, 5):
        parts = simhash.group_bits(correlation, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        assert max(map(len, parts)) - min(map(len, parts)) <= 1
        assert sum(any({a, b} <= set(p) for p in parts) for a, b in ((0, 40), (5, 63), (17, 33))) == 3


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _joined(spark, prints, **options):
    df = spark.createDataFrame([(_signed(p),) for p in sorted(set(prints))], "fp long")
    links = [(r.a, r.b) for r in simhash.near_links(df, **options).collect()]
    for a, b in links:
        assert a != b
    of = {_signed(p): _signed(p) for p in prints}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        of[find(a)] = find(b)
    groups = {}
    for p in set(prints):
        groups.setdefault(find(_signed(p)), set()).add(p)
    return sorted(map(sorted, groups.values())), len(links)


def _want(prints):
    prints = sorted(set(prints))
    groups = {}
    for p, c in zip(prints, brute.components(prints, prints)):
        groups.setdefault(c, []).append(p)
    return sorted(groups.values())


def test_links_join_what_all_pairs_join(spark):
    rng = random.Random(3)
    prints = []
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            prints.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))))
    prints += [0, 1, 3, (1 << 64) - 1, (1 << 63)]
    assert _joined(spark, prints)[0] == _want(prints)


def test_a_dense_group_costs_rows_in_proportion(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = [centre] + [centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)][:900]
    groups, rows = _joined(spark, prints, block=64)  # many block pairs
    assert groups == _want(prints)
    pairs = len(prints) * (len(prints) - 1) // 2
    assert rows < pairs / 2


def test_near_duplicates_of_texts(spark):
    rng = random.Random(5)
    base = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.choice([5, 80, 300]))) for _ in range(25)]
    rows = []
    for t in base:
        for _ in range(rng.randrange(1, 4)):
            w = t.split(" ")
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = "Edited"
            rows.append((len(rows) + 10, " ".join(w)))
    rows += [(3, None), (4, ""), (5, " \n"), (None, base[0]), (None, "nobody has this text"), (10, rows[0][1]), (6, "ab")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, fp string, root string")
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    prints = [brute.fingerprint(t) for _, t in rows]
    comp = brute.components([i for i, _ in rows], prints)
    assert got == sorted(((i, _signed(p), c) for (i, _), p, c in zip(rows, prints, comp)), key=str)
    assert simhash.near_duplicates(df.limit(0)).collect() == []
