import random
from itertools import combinations

import pytest

from podium.llm import decontaminate

from . import brute


def _leak(text, items):
    """brute.leak without masks: every place of an item's every window."""
    d, found = brute.tokens(text), []
    for item, body in items:
        b = brute.tokens(body)
        width = min(decontaminate.OVERLAP, len(b))
        for s in range(len(b) - width + 1) if b else ():
            for q in range(1 - width, len(d)):
                n = sum(0 <= q + j < len(d) and d[q + j] == b[s + j] for j in range(width))
                if 100 * n >= decontaminate.SIMILARITY * width:
                    found.append((item, n))
    return (min(i for i, _ in found), max(n for _, n in found)) if found else None


@pytest.mark.parametrize("similarity", [60, 80, 100])
def test_masks_hit_every_accepted_window(similarity):
    for width in range(1, 15):
        gone = width - -(-width * similarity // 100)
        for places in combinations(range(width), gone):
            left = [i not in places for i in range(width)]
            assert any(all(left[p + o] for o, c in enumerate(m) if c == "1")
                       for m in decontaminate.masks_of(width, similarity) for p in range(width - len(m) + 1)), (width, places)


def test_leaks_match_a_search_without_masks(spark):
    rng = random.Random(5)
    items = [(n, " ".join(f"i{n}t{k}" for k in range(n))) for n in [*range(1, 18), 30]] + [(50, "i13t0 of i30t2")]
    docs = []
    for n, body in items[:-1]:
        width = min(n, decontaminate.OVERLAP)
        gone = width - -(-width * decontaminate.SIMILARITY // 100)
        for places in combinations(range(width), gone):
            at = rng.randrange(n - width + 1)
            w = body.split()[at:at + width]
            for p in places:
                w[p] = "changed"
            docs.append(" ".join(["x"] * rng.randrange(3) + w + ["y"] * rng.randrange(3)))
        docs.append(" ".join("z" if k % 3 == 1 else x for k, x in enumerate(body.split())))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.matched) for r in decontaminate.leaks(df, bench).collect()}
    want = {i: _leak(t, items) for i, t in enumerate(docs)}
    assert got == {i: x for i, x in want.items() if x}
    assert 400 < len(got) < len(docs)
