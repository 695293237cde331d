from podium.llm import line_dedup


def test_a_small_site_loses_its_common_footer(spark):
    rows = [(i, f"own line {i}\nanother of {i}\nHome About Contact", "four") for i in range(4)]
    rows += [(10 + i, f"text of {i}\nboth pages", "two") for i in range(2)] + [(20, "only page\nits line", "one")]
    # copies counted as one page, whose lines are its own
    rows += [(30 + i, "copied\npage", "copies") for i in range(6)]
    # two of thirty pages are under the ratio
    rows += [(40 + i, f"page {i}" + "\nrare" * (i < 2), "thirty") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.drop_boilerplate(df, copies_once=True).collect()}
    want = {i: (0, t) for i, t, _ in rows}
    want |= {i: (1, f"own line {i}\nanother of {i}") for i in range(4)} | {10 + i: (1, f"text of {i}") for i in range(2)}
    assert got == want
