"""Quality rules (operator 8): base rules and an n-gram log-likelihood ratio between
a trusted target and the raw corpus.

The base rules are native expressions.  Tokens and neighbouring pairs are counted under
their hashes for two multinomials: over every document (raw), and over the trusted rows
(target).  Both are smoothed by the same ``PRIOR``, counted in target tokens,
so an n-gram seldom seen weighs next to nothing however small the corpus.  An
n-gram's weight is the logarithm of the ratio of its two shares, in whole
millionths, so a document's sum does not depend on the order of addition and
its verdict is the same in every run.  The mean weight of a document's n-grams must
reach a fixed threshold.  Counting is in ``ngram_ratio.py``; all of it is in DataFrame
operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE
from .ngram_ratio import MICRO, Limits, ratio_totals, text_key

#: least mean log-likelihood ratio of a document that is kept
THRESHOLD = -0.2
#: tokens added to an n-gram's count in the target, and their equivalent in the raw corpus
PRIOR = 30
WINDOW = 8
#: lowest bits of a sorted window that hold its place
PLACE_BITS = 24
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _carried(docs: DataFrame) -> list[str]:
    """Names under which the columns of ``docs`` travel: one by one, so those that
    nobody asks for are pruned before a shuffle."""
    return [f"row{i}" for i in range(len(docs.columns))]


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _one_space(text: Column) -> Column:
    """The text with every white-space character as a space: plain byte searches, by which words
    are split and counted without a regular expression.  Line ends are common; a text without any
    of the others is not copied for them."""
    def spaces(which):
        return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), which, text)

    others = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in "\t\v\f\r"])
    return F.when(others, spaces("\t\n\v\f\r")).otherwise(spaces("\n"))


def _joined(hashes: Column, by: int) -> Column:
    """Each hash with the one ``by`` places on, if there is one, under one hash."""
    return F.zip_with(hashes, F.slice(hashes, by + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def _repeats(items: Column) -> Column:
    """How many items equal an earlier one."""
    return F.size(items) - F.size(F.array_distinct(items))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: its columns as ``row0``, ``row1`` and so on, the key of its
    text and the base counts.

    n_words and word_chars (words and their code points), n_symbols (characters
    of ``[#*$%&|<>]``), n_dup_lines (lines with a word that equal an earlier
    line), n_repeat_words (words in 8-word windows found twice or more in the
    text, the first included), base_failed (under 20 words, or over 30 in 100
    words repeated).  A null or empty text has no words and fails.
    """
    row = _carried(docs)
    d = docs.select(*[F.col(f"`{c}`").alias(r) for c, r in zip(docs.columns, row)],
                    F.coalesce(F.col(text), F.lit("")).alias("t"))
    t, spaced = F.col("t"), F.col("spaced")
    d = d.withColumn("spaced", _one_space(t))
    d = d.select(*row, *text_key(t), _hashes(F.array_remove(F.split(spaced, " "), "")).alias("hashes"),
                 F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                 F.length(F.replace(spaced, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
                 F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"))
    h, n = F.col("hashes"), F.size("hashes")
    # hashes of 2, then of 4 neighbours; the last few of each are cut short and equal no other. In a
    # repeated window of 8 words each of the 7 pairs and each of the 5 windows of 4 words has been
    # there before, so a text with fewer repeats of either has none
    d = d.select(*row, "k1", "k2", n.cast("long").alias("n_words"), "word_chars", "n_symbols",
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 _joined(h, 1).alias("twos"))
    d = d.withColumn("fours", F.when(_repeats(F.col("twos")) >= WINDOW - 1, _joined(F.col("twos"), 2))).drop("twos")
    f = F.col("fours")
    d = d.withColumn("windows", F.when(_repeats(f) >= WINDOW - 3, F.slice(
        _joined(f, 4), 1, F.greatest(F.size(f) - (WINDOW - 1), F.lit(0))))).drop("fours")
    w = F.col("windows")
    d = d.withColumn("n_distinct", F.size(F.array_distinct(w)))
    repeated = w.isNotNull() & (F.col("n_distinct") < F.size(w))
    # only texts with a repeated window are sorted: by (window, place), where twins are neighbours. In one
    # long, if the upper bits of the hashes tell all windows of the text apart and the places fit
    # below them, else in full
    low = (1 << PLACE_BITS) - 1
    d = d.withColumn("keys", F.when(repeated & (F.size(w) <= low), F.transform(w, lambda x: x.bitwiseAND(F.lit(~low)))))
    d = d.withColumn("packed", F.when(
        F.col("keys").isNotNull() & (F.size(F.array_distinct("keys")) == F.col("n_distinct")),
        F.sort_array(F.transform("keys", lambda x, i: x.bitwiseOR(i.cast("long"))))))
    d = d.withColumn("twins", F.when(
        repeated & F.col("packed").isNull(),
        F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    packed, twins = F.col("packed"), F.col("twins")

    def twin(s, j, same):
        return F.coalesce(same(F.get(s, j + 1)), F.lit(False)) | F.coalesce(same(F.get(s, j - 1)), F.lit(False))

    # two keys agree if they differ in the place alone
    d = d.withColumn("at", F.when(packed.isNotNull(), F.sort_array(F.transform(
        F.filter(packed, lambda p, j: twin(packed, j, lambda q: q.bitwiseXOR(p).between(0, low))),
        lambda p: p.bitwiseAND(F.lit(low)).cast("int")))).otherwise(F.sort_array(F.transform(
            F.filter(twins, lambda p, j: twin(twins, j, lambda q: q["x"] == p["x"])), lambda p: p["i"]))))
    at = F.col("at")
    covered = F.aggregate(
        F.transform(F.slice(at, 2, F.size(at)), lambda x, i: F.least(F.lit(WINDOW), x - F.get(at, i))),
        F.lit(WINDOW).cast("long"), lambda total, x: total + x)
    d = d.withColumn("n_repeat_words", F.when(at.isNull(), F.lit(0).cast("long")).otherwise(covered))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return d.withColumn("base_failed", failed).select(*row, "k1", "k2", *BASE)


def quality_verdicts(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     threshold: float = THRESHOLD, limits: Limits = Limits()) -> DataFrame:
    """One row per document: ``row`` (all its columns), the base counts,
    base_failed, llr_micro (mean log-likelihood ratio, in millionths; null if it
    has no token) and kept.

    kept is false if a base rule failed, else whether llr_micro reaches the
    threshold.  Without trusted rows every weight is 0 and the base rules
    decide; an empty table gives no rows.  Repeated rows are judged alike; null ids are
    never trusted.
    """
    totals = ratio_totals(docs, trusted, doc_id, text, PRIOR, limits)
    d = base_rules(docs, text).withColumn("bare", F.col("n_words") == 0)
    # nth, never negative, keeps the optimizer from copying all rules into a filter on kept; a
    # text without tokens meets no total, and by nth no other such text
    d = d.withColumn("nth", F.monotonically_increasing_id())
    d = d.withColumn("k1", F.when(F.col("bare"), F.col("nth")).otherwise(F.col("k1")))
    d = d.join(totals, ["k1", "k2"], "left").withColumn("total", F.when(~F.col("bare"), F.col("total")))
    d = d.withColumn("llr_micro", F.floor(F.col("total") / F.col("grams")))
    kept = ~F.col("base_failed") & (F.col("llr_micro") >= F.lit(round(threshold * MICRO))) & (F.col("nth") >= 0)
    row = F.struct(*[F.col(r).alias(c) for r, c in zip(_carried(docs), docs.columns)]).alias("row")
    return d.select(row, *BASE, "llr_micro", F.coalesce(kept, F.lit(False)).alias("kept"))
