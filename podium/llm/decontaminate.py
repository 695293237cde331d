"""Benchmark decontamination by spaced seeds (operator 9, native).

A seed is a fixed mask over consecutive tokens; the positions marked 0 are
ignored, so a substituted token there does not hide the overlap.  An item's masks
are a family that hits every window the rule accepts, wherever its substitutions
are, so the seeds leave no overlap out, down to items of one token.  Hashes of the
benchmark's seeds, with the tokens around them, are broadcast in blocks of a
set number of rows and joined with the hashes of every seed of every document.
Around a hit, the two texts are aligned and compared token by token: an overlap
is a window of ``OVERLAP`` tokens holding the seed in which at least
``SIMILARITY`` per cent agree.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: 1: the token must agree.  The first family hits every window of 13 with two substitutions,
#: the second every shorter one of four tokens or more that reaches 80 per cent
FAMILIES = (("11101011", "11001111"), ("1111", "11011", "10111", "11101"))
MASKS = tuple(m for family in FAMILIES for m in family)
#: placements of substitutions a family is tried against; wider windows take a run of tokens
MAX_PLACEMENTS = 100_000
OVERLAP = 13
SIMILARITY = 80
#: benchmark seeds broadcast at once (some 250 bytes each)
SEEDS_PER_BLOCK = 200_000


def _token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    tokens = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(tokens, lambda w: F.xxhash64(w))


def hits_all(masks: tuple[str, ...], width: int, substitutions: int) -> bool:
    """Whether a mask fits beside any so many substitutions in a window."""
    places = [{p + o for o, c in enumerate(m) if c == "1"} for m in masks for p in range(width - len(m) + 1)]
    return all(any(ones.isdisjoint(gone) for ones in places) for gone in combinations(range(width), substitutions))


def masks_of(width: int, similarity: int = SIMILARITY) -> tuple[str, ...]:
    """Masks that hit every window of ``width`` tokens in which ``similarity`` per cent
    agree: the first such family, else the run of tokens that any placement leaves."""
    agree = min(width, max(1, -(-width * similarity // 100)))
    gone = width - agree
    if math.comb(width, gone) <= MAX_PLACEMENTS:
        for family in FAMILIES:
            if hits_all(family, width, gone):
                return family
    return ("1" * -(-agree // (gone + 1)),)


def _seed(h: Column, p: Column, mask: str) -> Column:
    """Hash of the masked tokens from place p on; null where the mask doesn't fit.
    Compiled code, unlike a lambda over the tokens."""
    return F.when(p + len(mask) <= F.size(h),
                  F.xxhash64(F.lit(mask), *[F.get(h, p + o) for o, c in enumerate(mask) if c == "1"]))


def benchmark_seeds(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
                    overlap: int = OVERLAP, similarity: int = SIMILARITY) -> DataFrame:
    """(seed, mask, context, lead, width, first, last, item): each distinct seed with
    the tokens that windows around it can reach.

    ``lead`` tokens of the context come before the seed; windows have ``width``
    tokens (all of a shorter item) and begin from ``first`` to ``last`` in the context.
    Items that agree on all of this are one row, named by the smallest id.  An item
    has the seeds of the masks that its width needs.
    """
    items = benchmark.select(F.col(item_id).alias("item"), _token_hashes(F.col(text)).alias("h"))
    widths: dict[str, list[int]] = {}
    for width in range(1, overlap + 1):
        for mask in masks_of(width, similarity):
            widths.setdefault(mask, []).append(width)
    parts = []
    for mask, served in widths.items():
        span = len(mask)
        n, p = F.size("h"), F.col("p")
        start = F.greatest(p - (overlap - span), F.lit(0))
        end = F.least(p + overlap, n)
        width = F.least(F.lit(overlap), n)
        parts.append(items.where(width.isin(served)).select("item", "h", F.posexplode("h").alias("p", "token"))
                     .select("item", "h", "p", _seed(F.col("h"), p, mask).alias("seed")).where("seed is not null")
                     .select("seed", F.lit(mask).alias("mask"), F.slice("h", start + 1, end - start).alias("context"),
                             (p - start).alias("lead"), width.alias("width"),
                             (F.greatest(p + span - width, F.lit(0)) - start).alias("first"),
                             (F.least(p, n - width) - start).alias("last"), "item"))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("seed", "mask", "context", "lead", "width", "first", "last").agg(F.min("item").alias("item"))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text", overlap: int = OVERLAP,
          similarity: int = SIMILARITY, seeds_per_block: int = SEEDS_PER_BLOCK) -> DataFrame:
    """(doc_id, item_id, matched) of the documents that overlap a benchmark item:
    the smallest such item (of equal contexts, the smallest) and the most tokens
    that agree in one window.

    Case, punctuation and white space don't count.  An item of under ``overlap``
    tokens is one window, so one of a single token matches every document that
    holds it; null texts have no tokens and never match.  Rows with equal doc_ids, null included, share a verdict.
    """
    seeds = materialize(benchmark_seeds(benchmark, item_id, item_text, overlap, similarity), "benchmark_seeds")
    per_mask = {r["mask"]: r["count"] for r in seeds.groupBy("mask").count().collect()}  # a row per mask
    n_blocks = max(1, math.ceil(sum(per_mask.values()) / seeds_per_block))
    # outer: an inner explode would put a filter that computes the tokens again before it
    h, p = F.col("h"), F.col("p")
    tokens = docs.select(F.col(doc_id).alias("doc"), _token_hashes(F.col(text)).alias("h")).select(
        "doc", "h", F.posexplode_outer("h").alias("p", "token"))
    sown = tokens.select("doc", "h", "p", F.explode_outer(F.array(
        *[_seed(h, p, m) for m in sorted(per_mask) or MASKS[:1]])).alias("s"))
    hits = reduce(DataFrame.unionByName, [
        sown.join(F.broadcast(seeds.where(F.pmod("seed", F.lit(n_blocks)) == b)), F.col("s") == F.col("seed"))
        for b in range(n_blocks)])
    # the document's tokens opposite the context, from its first if the context begins before it; nth, never
    # negative, keeps what follows from moving into the join, whose rows would then carry whole documents
    skip = F.greatest(F.col("lead") - p, F.lit(0))
    hits = hits.select("doc", "item", "context", "width", "first", "last", skip.alias("skip"),
                       F.slice(h, p - F.col("lead") + skip + 1, F.size("context") - skip).alias("near"),
                       F.monotonically_increasing_id().alias("nth"))
    agree = F.transform("context", lambda x, j: F.coalesce(
        (F.get("near", j - F.col("skip")) == x).cast("int"), F.lit(0)))
    hits = hits.select("doc", "item", "width", "first", "last", "nth", agree.alias("agree"))
    best = F.array_max(F.transform(
        F.sequence("first", "last"),
        lambda s: F.aggregate(F.slice("agree", s + 1, F.col("width")), F.lit(0), lambda total, x: total + x)))
    found = (hits.select("doc", "item", "width", "nth", best.alias("matched"))
             .where((F.col("matched") * 100 >= F.col("width") * similarity) & (F.col("nth") >= 0)))
    return (found.groupBy("doc").agg(F.min("item").alias("item_id"), F.max("matched").cast("long").alias("matched"))
            .withColumnRenamed("doc", "doc_id"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without an overlap, all columns as they were."""
    found = materialize(leaks(docs, benchmark, doc_id, text, **options).select(F.col("doc_id").alias("__leak")), "leaks")
    return docs.join(found, docs[doc_id].eqNullSafe(found["__leak"]), "left_anti")
