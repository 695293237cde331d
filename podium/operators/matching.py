"""Upstream steps known only from the reference's outputs.

U3 (season percentiles) and U4 (group z-scores) live in :mod:`.windows`.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col_ref

# ---------------------------------------------------------------------------
# Lower-case Latin letters that stand for two
# ---------------------------------------------------------------------------
TWO_LETTERS = {"æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "ŋ": "ng", "ĳ": "ij", "ǆ": "dz", "ǉ": "lj", "ǌ": "nj", "ǳ": "dz"}
# ---------------------------------------------------------------------------


@cache
def _letter_folding() -> tuple[str, str]:
    """Lower-case Latin letters with a mark, stroke, hook or other change, and the ASCII
    letter each is a form of, by its Unicode decomposition or else its character name."""
    accented, folded = "", ""
    for code in [*range(0xDF, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = unicodedata.normalize("NFKD", letter)[0]
        if not base.isascii():
            named = re.fullmatch(r"LATIN SMALL LETTER (?:DOTLESS )?([A-Z])(?: WITH .*)?", unicodedata.name(letter, ""))
            base = named[1].lower() if named else "d" if letter == "ð" else ""
        if len(base) == 1 and base.islower() and letter not in TWO_LETTERS:
            accented, folded = accented + letter, folded + base
    return accented, folded


def normalize_name(c) -> Column:
    """Lower case, Latin letters of every accent folded to ASCII (č ć ā ı ł ø ..., whether
    one character or a letter and a combining mark), every run of
    non-alphanumerics collapsed to one blank, trimmed."""
    x = F.regexp_replace(F.lower(F.trim(col_ref(c).cast("string"))), r"\p{M}", "")
    x = F.translate(x, *_letter_folding())
    for letter, two in TWO_LETTERS.items():
        x = F.replace(x, F.lit(letter), F.lit(two))
    return F.trim(F.regexp_replace(x, r"[^a-z0-9]+", " "))


def _delete_variants(key: Column, deletions: int = 1) -> Column:
    """The key itself and every string obtained by deleting up to ``deletions``
    characters."""
    found = F.array(key)
    for _ in range(deletions):
        shorter = F.flatten(F.transform(found, lambda k: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(k), F.lit(1))),
            lambda i: F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k))))))
        found = F.array_distinct(F.concat(found, shorter))
    return found


def entity_match(left: DataFrame, right: DataFrame, left_name: str, right_name: str,
                 left_id: str, right_id: str, max_distance: int = 0) -> DataFrame:
    """Match names without a shared id.

    Both sides get a normalised key (:func:`normalize_name`); duplicate keys
    are folded first (the lowest right id represents a right key).  Equal keys
    match (an equi-join).  With ``max_distance = d`` a left key without an equal
    right key is matched to the nearest right key at an edit distance of at most
    d, the lowest id among equally near ones: candidates are pairs that share a
    variant with up to d deletions (every pair at distance <= d does), verified
    with ``levenshtein``.  Distinct keys sharing a variant differ in d positions
    at most, so a variant group is bounded by (key length x alphabet size) to the
    power d, never by the data size.  Output: left id and name, key, right id and
    name, distance; unmatched left rows keep NULLs."""
    if max_distance < 0:
        raise ValueError("max_distance must not be negative")
    lk = left.select(col_ref(left_id).alias("left_id"), col_ref(left_name).alias("left_name"),
                     normalize_name(left_name).alias("key"))
    rk = (right.select(col_ref(right_id).alias("right_id"), col_ref(right_name).alias("right_name"),
                       normalize_name(right_name).alias("rkey"))
          .where(F.col("rkey") != "")
          .groupBy("rkey").agg(F.min(F.struct("right_id", "right_name")).alias("__best")))
    lkeys = lk.select("key").where(F.col("key") != "").distinct()
    exact = lkeys.join(rk, lkeys["key"] == rk["rkey"], "inner").select(
        "key", F.struct(F.lit(0).alias("d"), F.col("__best.right_id").alias("right_id"),
                        F.col("__best.right_name").alias("right_name")).alias("__m"))
    matches = exact
    if max_distance > 0:
        todo = lkeys.join(exact.select("key"), "key", "left_anti")
        lv = todo.select("key", F.explode(_delete_variants(F.col("key"), max_distance)).alias("__v"))
        rv = rk.select("rkey", "__best", F.explode(_delete_variants(F.col("rkey"), max_distance)).alias("__v"))
        cand = lv.join(rv, "__v", "inner").select("key", "rkey", "__best").distinct()
        cand = cand.withColumn("d", F.levenshtein("key", "rkey")).where((F.col("d") > 0) & (F.col("d") <= max_distance))
        near = cand.groupBy("key").agg(F.min(F.struct(
            "d", F.col("__best.right_id").alias("right_id"), F.col("__best.right_name").alias("right_name"))).alias("__m"))
        matches = exact.unionByName(near)
    # rows without a key match nothing; their hash keeps them from meeting in one task
    alone = F.when(F.coalesce(F.col("key"), F.lit("")) == "", F.xxhash64("left_id", "left_name"))
    lk = lk.withColumn("__alone", F.coalesce(alone, F.lit(0)))
    matches = matches.withColumnRenamed("key", "__key").withColumn("__none", F.lit(0).cast("long"))
    j = lk.join(matches, F.col("key").eqNullSafe(F.col("__key")) & (F.col("__alone") == F.col("__none")), "left")
    return j.select("left_id", "left_name", "key", F.col("__m.right_id").alias("right_id"),
                    F.col("__m.right_name").alias("right_name"), F.col("__m.d").alias("distance"))


def merge_sources(base: DataFrame, sources: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-join each source on ``keys`` with its non-key columns renamed
    ``{prefix}{column}`` (``tot_``, ``adv_``, ... in the reference)."""
    keys = list(keys)
    out = base
    for prefix, src in sources.items():
        renamed = src.select(*[col_ref(k) for k in keys],
                             *[col_ref(c).alias(f"{prefix}{c}") for c in src.columns if c not in keys])
        out = out.join(renamed, keys, "left")
    return out

