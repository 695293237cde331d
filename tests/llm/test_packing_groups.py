from collections import Counter

from podium.llm import packing


def test_rows_with_equal_keys_are_dealt_to_many_groups(spark):
    rows = [(None, "", None)] * 300 + [(7, "a b c", "s")] * 300 + [(100 + i, "x " * (i % 9), "t") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = packing.best_fit(df, packing.word_length(), capacity=20, group_rows=50).collect()
    assert Counter((r.doc_id, r.length) for r in got) == Counter((i, len(t.split()) + 1) for i, t, _ in rows)
    groups = Counter(r.bin >> 32 for r in got)
    assert max(groups.values()) < 150
    for r in (None, 7):
        assert max(Counter(x.bin >> 32 for x in got if x.doc_id == r).values()) < 60
    sevens = [r.bin for r in got if r.doc_id == 7]
    assert len(set(sevens)) == len(sevens)
