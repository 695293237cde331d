"""Work that op 8 leaves out because it can't change a result."""

import random

from podium.llm import ngram_ratio, quality

from . import brute


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rare_white_space_and_windows_are_only_worked_on_where_needed(spark):
    plan = _plan(quality.base_rules(spark.createDataFrame([("a b",)], "text string")))
    spaced = next(x for x in plan.split("Project") if " AS spaced" in x)
    assert "CASE WHEN" in spaced and "contains(" in spaced.lower()
    fours = next(x for x in plan.split("Project") if " AS fours" in x)
    assert "CASE WHEN" in fours and "array_distinct(twos" in fours


def test_windows_at_the_least_number_of_repeats(spark):
    rng = random.Random(4)
    once = " ".join(f"u{i}" for i in range(30))
    eight = "a b c d e f g h"
    texts = [f"{eight} {once} {eight}", f"{once} {eight} {eight}", f"{eight}\t{once}\r\n{eight}", "z " * 9, "z " * 8,
             # seven words twice, several times over: repeated pairs and fours, but no window
             " ".join(f"{eight[:-2]} x{i}" for i in range(6)),
             f"{eight[:-2]} {once} {eight[:-2]}"]
    texts += [" ".join(rng.choices("pqrstuvw", k=rng.randrange(8, 40))) for _ in range(60)]
    got = quality.base_rules(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute.base_rules(r.row0)
        assert {k: r[k] for k in want} == want, r.row0
    assert {r.n_repeat_words for r in got if r.row0 in texts[:7]} == {0, 9, 16}


def test_ngrams_come_without_an_array_for_each_token(spark):
    tokens = spark.createDataFrame([(5, True, 3, [1, 2, 2]), (6, False, 1, [7, 8]), (7, False, 1, [9])],
                                   "doc long, good boolean, own int, h array<long>")
    grams = ngram_ratio.ngrams(tokens)
    assert _plan(grams).count("Generate") == 1
    pair = {r[0]: r[1] for r in spark.sql(
        "SELECT * FROM VALUES ('12', xxhash64(1L, 2L)), ('22', xxhash64(2L, 2L)), ('78', xxhash64(7L, 8L))").collect()}
    want = sorted([(11, 1), (11, 2), (11, 2), (11, pair["12"]), (11, pair["22"]), (12, 7), (12, pair["78"]), (14, 9)])
    assert sorted(map(tuple, grams.collect())) == want
    parts = [tuple(r) for s in range(3) for r in ngram_ratio.ngrams(tokens, 3, s).collect()]
    assert sorted(parts) == want
