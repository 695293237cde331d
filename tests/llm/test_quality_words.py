import random
import re

from podium.llm import quality

from . import brute


def test_words_and_symbols_between_any_white_space(spark):
    rng = random.Random(8)
    pieces = ["\t", "\n", "\v", "\f", "\r", " ", "  ", "\r\n", "\xa0", " ", "\x1c", "\x00", "a", "b", "é", "日本", "😀",
              "#", "*$", "%&|<>", "w|x", ".", "[", "\\"]
    texts = ["", " ", "\n\n", "\t a \v b \f", "\xa0", "#" * 50, None]
    texts += ["".join(rng.choices(pieces, k=rng.randrange(1, 90))) for _ in range(200)]
    got = quality.base_rules(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute.base_rules(r.row0)
        assert {k: r[k] for k in want} == want, r.row0


def test_no_text_is_split_or_copied_by_a_regular_expression(spark):
    rules = quality.base_rules(spark.createDataFrame([("a b",)], "text string"))
    plan = rules._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
    assert not re.search(r"split\([^,]*, \[", plan)
