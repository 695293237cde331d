from podium.llm import licenses
from podium.llm.license_texts import TEMPLATES


def _found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in licenses.find_licenses(df).collect():
        out[r.doc_id].append((r.start, r.license, r.end, r.matched, r.length))
    return [sorted(out[i]) for i in range(len(texts))]


def test_an_edited_text_wins_over_an_intact_notice_inside_it(spark):
    apache, bsd = (" ".join(TEMPLATES[n].split()) for n in ("Apache-2.0", "BSD-3-Clause"))
    texts = [apache.replace("limitations", "limits"), bsd.replace("endorse", "advertise"),
             "x y " + apache.replace("obtain", "get") + " between " + bsd.replace("prior", "earlier")]
    n = {k: len(licenses.words(TEMPLATES[k])) for k in TEMPLATES}
    got = _found(spark, texts)
    assert got[0] == [(0, "Apache-2.0", len(texts[0]) - 1, n["Apache-2.0"] - 1, n["Apache-2.0"])]
    assert got[1] == [(0, "BSD-3-Clause", len(texts[1]) - 1, n["BSD-3-Clause"] - 1, n["BSD-3-Clause"])]
    assert [x[1] for x in got[2]] == ["Apache-2.0", "BSD-3-Clause"]


def test_every_template_alone_is_named(spark):
    names = sorted(TEMPLATES)
    got = _found(spark, ["before it " + TEMPLATES[n] + " after it" for n in names])
    assert [[(x[1], x[3]) for x in g] for g in got] == [[(n, len(licenses.words(TEMPLATES[n])))] for n in names]


def test_a_short_notice_is_found_wherever_its_edit_is(spark):
    texts, names = [], []
    for name in ("MIT notice", "CC-BY-NC-4.0 notice", "Apache-2.0 notice", "CC-BY-SA-4.0"):
        w = licenses.words(TEMPLATES[name])
        for i in range(len(w)):
            texts += [" ".join(["x", *w[:i], "edited", *w[i + 1:], "y"]), " ".join(["x", *w[:i], *w[i + 1:], "y"])]
            names += [(name, len(w) - 1)] * 2
    for t, g, (name, matched) in zip(texts, _found(spark, texts), names):
        # the word that tells one license from another may be the edited one
        assert name == g[0][1] or (len(g) == 1 and g[0][3] >= matched), (t, g)
    assert _found(spark, ["It is released under MIT license now"])[0] == [(6, "MIT notice", 32, 4, 5)]
