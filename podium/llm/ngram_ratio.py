"""Hashed n-gram log-likelihood ratios of documents (for operator 8), in DataFrame operations.

Tokens are runs of letters and digits, or runs of other visible characters.  Every
token and every pair of neighbours is an n-gram, under a 64-bit hash; each has its own
counts, so the tables grow with the corpus.

1. Texts are cut into tokens once; the tokens' hashes are written as arrays, by which
   Parquet's dictionary makes a few bytes of each.
2. A bounded number of n-grams, those that come up most often in a part of the corpus, is
   broadcast.  They are counted over the whole corpus with partial sums, and weighed
   where their documents are: a frequent n-gram is no hot key.  Which n-grams these are
   only says which way they go: counts and weights are exact on either.
3. Each occurrence of any other n-gram is one row, sent to the part of its n-gram, which
   counts it, weighs it and adds up the weights of each document.  This is done in
   ``slices`` rounds; the shuffle files of a round go before the next begins.

Texts, n-grams and documents never reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, drop_folder, materialize, scratch_path, shuffles_dropped


@dataclass(frozen=True)
class Limits:
    """Sizes that bound a task's memory and a round's disk; results don't depend on them."""
    #: tokens of the part of the corpus that shows which n-grams are frequent, and n-grams taken from it at most
    chunk_tokens: int = 4_000_000
    chunk_words: int = 800_000
    #: texts over so many characters are cut into pieces of so many tokens
    long_text: int = 1_000_000
    piece_tokens: int = 200_000
    #: rounds of counting
    slices: int = 5
    #: n-gram occurrences of one part at most, on average
    part_grams: int = 2_000_000
    #: trusted ids that are broadcast at most; more are shuffled
    broadcast_ids: int = 100_000


MICRO = 1_000_000
TOKEN = rf"[\p{{L}}\p{{N}}]++|[^\p{{L}}\p{{N}}{SPACE}]++"
#: fewest occurrences in the part of the corpus for an n-gram to be taken as frequent
FREQUENT = 3


def text_key(text) -> list:
    """128 bits for each text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2")]


def token_rows(docs: DataFrame, trusted: DataFrame, doc_id: str, text: str, limits: Limits) -> DataFrame:
    """(doc, good, k1, k2, own, grams, h) of every text with a token: a number, whether its id
    is trusted, its :func:`text_key`, and the hashes of its tokens.  A long text has a row for
    each piece; ``own`` is the number of tokens that are no part of the next piece, which begins
    with the last of ``h``, and ``grams`` the number of n-grams."""
    ids = trusted.select(F.col(doc_id).alias("trusted_id")).where("trusted_id is not null").distinct()
    few = ids.limit(limits.broadcast_ids + 1).count() <= limits.broadcast_ids
    d = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.join(F.broadcast(ids) if few else ids, F.col("id") == F.col("trusted_id"), "left")
    tokens = F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0))
    d = d.select(F.monotonically_increasing_id().alias("doc"), F.col("trusted_id").isNotNull().alias("good"),
                 *text_key(F.col("t")), (F.length("t") > limits.long_text).alias("long"),
                 F.transform(tokens, lambda w: F.xxhash64(w)).alias("all"))
    n, size = F.size("all"), limits.piece_tokens
    cut = F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda i: F.struct(
        F.slice("all", i + 1, F.lit(size + 1)).alias("h"), F.least(F.lit(size), n - i).alias("own")))
    pieces = F.when(F.col("long") & (n > 0), cut).otherwise(F.array(F.struct(F.col("all").alias("h"), n.alias("own"))))
    # outer: an inner explode would put a filter that cuts the tokens again before it
    d = d.select("doc", "good", "k1", "k2", F.explode_outer(pieces).alias("p")).select(
        "doc", "good", "k1", "k2", "p.own", (F.col("p.own") + F.size("p.h") - 1).cast("long").alias("grams"), "p.h")
    return d.where("own > 0")


def ngrams(tokens: DataFrame, slices: int = 1, slice_: int = 0) -> DataFrame:
    """(v, gram) of every n-gram occurrence: twice the document's number, plus 1 if it is
    trusted, and a hash.  Of several slices one, by the n-gram's first token."""
    v = (2 * F.col("doc") + F.col("good").cast("long")).alias("v")
    d = tokens.select(v, "own", "h", F.posexplode("h").alias("i", "a")).where("i < own")
    if slices > 1:
        d = d.where(F.pmod(F.shiftrightunsigned("a", 33), F.lit(slices)) == slice_)
    after = F.get("h", F.col("i") + 1)
    d = d.select("v", "a", F.when(after.isNotNull(), F.xxhash64("a", after)).alias("pair"))
    # two rows of each without an array for each
    return d.unpivot("v", ["a", "pair"], "kind", "gram").where("gram is not null").select("v", "gram")


def weight(raw: Column, target: Column, scale: float, prior: int) -> Column:
    """In millionths, rounded half away from zero."""
    x = F.log((target + prior) / (raw * F.lit(scale) + prior)) * MICRO
    return F.when(x < 0, -F.floor(0.5 - x)).otherwise(F.floor(x + 0.5))


def frequent_ngrams(tokens: DataFrame, n_tokens: int, limits: Limits) -> DataFrame:
    """(gram): at most ``chunk_words`` n-grams, the most frequent of a part of the corpus."""
    of = 1 << 20
    part = tokens.where(F.pmod(F.xxhash64("doc"), F.lit(of)) < min(of, of * limits.chunk_tokens // n_tokens + 1))
    found = ngrams(part).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    found = materialize(found, "frequent")
    # the least count with few enough n-grams at or over it, to an eighth of a power of two
    step = F.floor(8 * F.log2("n")).cast("int")
    least, n = 8 * 63, 0
    for r in found.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # some hundred rows at most
        n += r["count"]
        if n > limits.chunk_words:
            break
        least = r.step
    return found.where(step >= least).select("gram")


def ratio_totals(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 prior: int = 30, limits: Limits = Limits()) -> DataFrame:
    """(k1, k2, total, grams) of every text of ``docs`` with a token, by its
    :func:`text_key`: the weights of its n-grams, in millionths, and their number.

    A weight is log((target + prior) / (raw * scale + prior)), rounded: ``raw`` counts the
    n-gram over all rows, ``target`` over those whose id is among ``trusted``, and
    ``scale`` is the share of n-grams that are in the target.  Null and repeated ids
    in ``trusted`` are ignored; repeated rows of ``docs`` count as often as they come.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    rows = token_rows(docs, trusted, doc_id, text, limits)
    with shuffles_dropped(spark):
        # a dictionary large enough for the words of a row group
        rows.write.option("compression", "zstd").option("parquet.dictionary.page.size", 8 << 20).parquet(folder)
    tokens = spark.read.schema(rows.schema).parquet(folder)
    sums = tokens.agg(F.sum("own").alias("tokens"), F.sum("grams").alias("raw"),
                      F.sum(F.when(F.col("good"), F.col("grams")).otherwise(0)).alias("target")).first()
    if not sums.raw:
        return spark.createDataFrame([], "k1 long, k2 long, total long, grams long")
    scale = sums.target / sums.raw

    frequent = frequent_ngrams(tokens, sums.tokens, limits)
    raw, target = F.count(F.lit(1)), F.sum(F.col("v").bitwiseAND(F.lit(1)))
    counts = ngrams(tokens).join(F.broadcast(frequent), "gram").groupBy("gram").agg(raw.alias("raw"), target.alias("target"))
    with shuffles_dropped(spark):
        counts = materialize(counts, "ngram_counts")
    rest = sums.raw - (counts.agg(F.sum("raw")).first()[0] or 0)

    weights = counts.select("gram", weight(F.col("raw"), F.col("target"), scale, prior).alias("w"))
    found = [ngrams(tokens).join(F.broadcast(weights), "gram")]
    parts = max(1, -(-rest // (limits.slices * limits.part_grams)))
    same = Window.partitionBy("gram")
    for s in range(limits.slices):
        others = ngrams(tokens, limits.slices, s).join(F.broadcast(frequent), "gram", "left_anti")
        others = others.repartition(parts, "gram").select("v", raw.over(same).alias("raw"), target.over(same).alias("target"))
        found.append(others.select("v", weight(F.col("raw"), F.col("target"), scale, prior).alias("w")))
    totals = []
    for s, weighed in enumerate(found):
        with shuffles_dropped(spark):
            totals.append(materialize(weighed.groupBy("v").agg(F.sum("w").alias("total")), f"ngram_totals_{s}"))
    totals = reduce(DataFrame.unionByName, totals).groupBy("v").agg(F.sum("total").alias("total"))
    keys = tokens.groupBy("doc", "k1", "k2").agg(F.sum("grams").alias("grams"))
    totals = keys.join(totals, F.col("doc") == F.shiftright("v", 1))
    # copies of a text agree
    totals = totals.groupBy("k1", "k2").agg(F.max("total").alias("total"), F.max("grams").alias("grams"))
    with shuffles_dropped(spark):
        totals = materialize(totals, "ngram_totals")
    drop_folder(spark, folder)
    return totals
