import random
import re

import pytest

from podium.llm import quality
from podium.llm.ngram_ratio import Limits

from . import brute


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("place_bits", [24, 50, 3])
def test_repeated_windows_whichever_way_they_are_sorted(spark, monkeypatch, place_bits):
    # 50: the upper bits of the hashes can't tell all windows apart; 3: the places don't fit
    monkeypatch.setattr(quality, "PLACE_BITS", place_bits)
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abc", k=n)) for n in range(0, 60, 3) for _ in range(4)]
    texts += ["x " * n for n in range(7, 20)] + [" ".join(map(str, range(n))) for n in (3, 4, 7, 8, 9, 300)]
    texts += ["p q r s t " * 3 + " ".join(map(str, range(400))) + " p q r s t" * 2,
              "1 2 3 4 u 1 2 3 4 v", " ".join(rng.choices("abcdefgh", k=3000))]
    got = quality.base_rules(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute.base_rules(r.row0)
        assert {k: r[k] for k in want} == want, r.row0


def test_quality_rules_run_no_python(spark):
    df = spark.createDataFrame([(i, f"w{i} " * 5 + " ".join(f"x{j}" for j in range(i, i + 40))) for i in range(30)],
                               "doc_id long, text string")
    out = quality.quality_verdicts(df, df.select("doc_id").where("doc_id < 9"), limits=Limits(chunk_words=10))
    assert out.count() == 30
    totals = quality.ratio_totals(df, df.select("doc_id"), limits=Limits(chunk_words=10))
    assert totals.count() == 30
    for plan in (_plan(out.drop("row")), _plan(totals)):
        assert not re.search("Python|Pandas|Arrow", plan)
    import podium.llm.ngram_ratio as ratio
    assert not re.search("mapInArrow|applyInArrow|pandas", open(ratio.__file__).read())
