import math
import random
from collections import Counter

import pytest
import regex

from podium.llm import quality
from podium.llm.ngram_ratio import Limits


def _grams(text):
    t = regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+", text)
    return t + list(zip(t, t[1:]))


SMALL = {"chunk_tokens": 700, "piece_tokens": 7, "long_text": 300, "part_grams": 5000, "broadcast_ids": 3}


@pytest.mark.parametrize("limits", [Limits(), Limits(**SMALL, slices=2), Limits(**SMALL, slices=8, chunk_words=100)])
def test_every_ngram_of_a_larger_corpus_has_its_own_weight(spark, limits):
    rng = random.Random(3)
    # frequent words and pairs, and 60,000 distinct n-grams
    rows = [(i, " ".join(x for k in range(60) for x in (rng.choice("abcdefgh") + str(i % 2), f"w{i}n{k}")))
            for i in range(400)]
    rows += [(1000, rows[0][1]), (None, rows[0][1]), (0, rows[1][1]), (1001, ""), (1002, None)]
    trusted = set(range(0, 400, 2))
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(_grams(t or ""))
        if i in trusted:
            target.update(_grams(t or ""))
    scale = target.total() / raw.total()
    weight = {g: math.log((target[g] + quality.PRIOR) / (raw[g] * scale + quality.PRIOR)) * quality.MICRO for g in raw}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in trusted] + [(None,)], "doc_id long")
    got = quality.quality_verdicts(df, ids, limits=limits).collect()
    assert sorted(str(r.row.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    for r in got:
        g = _grams(r.row.text or "")
        assert (r.llr_micro is None) == (not g)
        assert not g or abs(r.llr_micro - sum(weight[x] for x in g) / len(g)) <= 2
    assert {r.kept for r in got} == {True, False}
