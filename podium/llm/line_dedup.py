"""Site-relative line frequency (operator 5).

A line of a site is boilerplate if the pages of that site holding it are more
than ``ratio`` of the site's pages.  Only 128-bit line hashes are counted and
shuffled; texts move once, to meet the lines they lose.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize

RATIO_PERCENT = 10
#: tells a line that pages share from one page's own, which is over the ratio on a site of under ten pages
MIN_PAGES = 2


def _line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit("line"), line).alias("g"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate_lines(docs: DataFrame, text: str = "text", host: str = "source", ratio_percent: int = RATIO_PERCENT,
                      min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """(host, line key, pages, total) of the lines over the ratio.

    Every row with a text is a page.  With ``copies_once`` pages of a site with
    equal texts count as one, above and below the line, so a page that a site
    holds many times does not turn its own text into boilerplate.  Lines
    without a word are never counted.  A line must be on ``min_pages`` pages at
    least.
    """
    pages = docs.where(F.col(text).isNotNull()).select(
        F.col(host).alias("host"), F.xxhash64(text).alias("page"), F.col(text).alias("text"))
    lines = (pages.select("host", "page", F.explode_outer(F.array_distinct(_lines(F.col("text")))).alias("line"))
             .where(F.col("line").rlike(f"[^{SPACE}]"))
             .select("host", "page", _line_key(F.col("line")).alias("key")))
    # counts aggregate before the shuffle, so a hot site or line is spread over its pages
    n = F.count_distinct("page") if copies_once else F.count("page")
    counts = lines.groupBy("host", "key").agg(n.alias("pages")).where(F.col("pages") >= min_pages)
    totals = pages.groupBy(F.col("host").alias("site")).agg(n.alias("total"))
    found = counts.join(totals, F.col("host").eqNullSafe(F.col("site"))).where(
        F.col("pages") * 100 > F.col("total") * ratio_percent)
    return found.select("host", "key", "pages", "total")


def drop_boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                     ratio_percent: int = RATIO_PERCENT, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """(doc_id, host, n_lines, n_dropped, text) plus the other columns of ``docs``
    under ``row``, for every row; ``text`` has lost its site's boilerplate lines.

    Lines are the pieces between line feeds; the rest keeps its order.  A null
    text stays null with 0 lines; an empty one has one (empty) line.  Rows with
    a null host form a site of their own; null or repeated doc_ids are
    kept, each row judged by its own lines.  Rows repeated in full are pages of their
    own unless ``copies_once``.  An empty table gives no rows; other columns may have any
    name.  The work on a text grows with its lines plus those it loses.
    """
    boiler = materialize(boilerplate_lines(docs, text, host, ratio_percent, min_pages, copies_once), "boilerplate")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(host).alias("host"), F.xxhash64(text).alias("page"),
                       _lines(F.col(text)).alias("lines"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    lines = (docs.where(F.col(text).isNotNull())
             .select(F.col(doc_id).alias("id"), F.col(host).alias("host"), F.xxhash64(text).alias("page"),
                     F.posexplode(_lines(F.col(text))).alias("place", "line"))
             .where(F.col("line").rlike(f"[^{SPACE}]")).withColumn("key", _line_key(F.col("line"))))
    b = boiler.select(F.col("host").alias("site"), F.col("key").alias("bad"))
    mine = ("id", "host", "page")
    hits = (lines.join(b, F.col("host").eqNullSafe(F.col("site")) & (F.col("key") == F.col("bad")))
            .groupBy(*[F.col(c).alias(f"hit_{c}") for c in mine])
            .agg(F.sort_array(F.collect_set("place")).alias("drop")))
    joined = rows.join(hits, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"hit_{c}")) for c in mine]), "left")

    def between(i: Column) -> Column:
        """The lines after the drop before place ``i`` of the drops, up to the next."""
        start = F.when(i == 0, 0).otherwise(F.get("drop", i - 1) + 1)
        end = F.when(i == F.size("drop"), F.size("lines")).otherwise(F.get("drop", i))
        return F.slice("lines", start + 1, end - start)

    # in time that grows with lines plus drops, not with their product
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("drop")), between))
    given = F.col("lines").isNotNull()
    return joined.select(
        F.col("id").alias("doc_id"), "host",
        F.when(given, F.size("lines")).otherwise(0).cast("long").alias("n_lines"),
        F.when(F.col("drop").isNotNull(), F.size("drop")).otherwise(0).cast("long").alias("n_dropped"),
        F.when(given, F.array_join(F.when(F.col("drop").isNull(), F.col("lines")).otherwise(runs), "\n")).alias("text"), "row")
