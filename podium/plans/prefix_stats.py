"""Medians, means and deviations of every training part that ends at a period.

The parts of a walk-forward study or a learning curve are prefixes of the periods, so
they need no pass of their own: a distinct value of a feature is counted once for
every cut, running counts over the values give all medians, and running sums over one
row per (feature, period) give all means and deviations.  The jobs don't grow with
the number of parts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import col_ref, inf_to_null
from ..operators import ordering as O
from .models import MedianImputer, Prepared, Scaler

#: cuts counted side by side in one row of a distinct value; more cuts take more rows
CUTS_PER_ROW = 32


def _long(df: DataFrame, cols: Sequence[str], period_col: str) -> DataFrame:
    """(feature, value, period): one row per row and feature; values that aren't finite are null."""
    pairs = [F.struct(F.lit(c).alias("feature"), inf_to_null(c).cast("double").alias("value")) for c in cols]
    return df.where(col_ref(period_col).isNotNull()).select(
        F.explode(F.array(*pairs)).alias("x"), col_ref(period_col).alias("period")).select("x.feature", "x.value", "period")


def _in_part(period: Column, cut: Column, inclusive: bool) -> Column:
    return period <= cut if inclusive else period < cut


def _medians(long: DataFrame, cuts: Sequence, inclusive: bool) -> DataFrame:
    """(feature, cut, median) of the parts that have a value of the feature."""
    chunks = [list(cuts[i:i + CUTS_PER_ROW]) for i in range(0, len(cuts), CUTS_PER_ROW)]
    places = range(len(chunks[0]))

    def cut_at(i: int) -> Column:
        return F.get(F.array(*[F.lit(c[i]) if i < len(c) else F.lit(None) for c in chunks]), F.col("chunk"))

    values = long.where("value is not null").withColumn("chunk", F.explode(F.array(*map(F.lit, range(len(chunks))))))
    folded = values.groupBy("feature", "chunk", "value").agg(*[
        F.sum(F.when(_in_part(F.col("period"), cut_at(i), inclusive), 1).otherwise(0)).alias(f"w{i}") for i in places])
    running = O.running_totals(folded, ["feature", "chunk"], [("value", True)], [f"w{i}" for i in places], totals="all_")

    def covering(i: int, place: Column) -> Column:
        through = F.col(f"cum_w{i}")
        return F.max(F.when((through - F.col(f"w{i}") <= place) & (place < through), F.col("value")))

    def middle(i: int) -> Column:
        return (F.col(f"all_w{i}") - 1) / F.lit(2.0)

    ends = running.groupBy("feature", "chunk").agg(*[
        F.struct(covering(i, F.floor(middle(i))).alias("lo"), covering(i, F.ceil(middle(i))).alias("hi")).alias(f"m{i}")
        for i in places])
    parts = F.array(*[F.struct(cut_at(i).alias("cut"), F.col(f"m{i}.lo").alias("lo"), F.col(f"m{i}.hi").alias("hi"))
                      for i in places])
    out = ends.select("feature", F.explode(parts).alias("x")).where("x.cut is not null and x.lo is not null")
    # an even count has its median half way between two values
    return out.select("feature", F.col("x.cut").alias("cut"), (F.col("x.lo") + (F.col("x.hi") - F.col("x.lo")) / 2).alias("median"))


def _moments(long: DataFrame, cuts: Sequence, inclusive: bool) -> DataFrame:
    """(feature, cut, n_rows, n, s, d, m2, low, high): rows and values of the part, the
    feature's mean over all periods ``s``, the part's mean less ``s``, the sum of squares
    about the part's mean, its extremes."""
    per = long.groupBy("feature", "period").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("k"), F.avg("value").alias("avg"),
        F.var_pop("value").alias("var"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    # a marker row for each cut stands among the periods, before or after the period of the same value
    marks = per.select("feature").distinct().select("feature", F.explode(F.array(*map(F.lit, cuts))).alias("period"))
    rows = per.withColumn("mark", F.lit(False)).unionByName(marks.withColumn("mark", F.lit(True)), allowMissingColumns=True)
    feature = Window.partitionBy("feature")  # a row per period and cut
    before = feature.orderBy("period", F.col("mark").asc() if inclusive else F.col("mark").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # sums about the feature's mean, so large values don't cancel
    rows = rows.withColumn("s", F.sum(F.col("avg") * F.col("k")).over(feature) / F.sum("k").over(feature))
    off = F.col("avg") - F.col("s")
    summed = rows.select(
        "feature", "period", "mark", "s",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("n"),
        F.sum(off * F.col("k")).over(before).alias("s1"), F.sum(F.col("k") * (F.col("var") + off * off)).over(before).alias("s2"),
        F.min("lo").over(before).alias("low"), F.max("hi").over(before).alias("high")).where("mark")
    d = F.when(F.col("n") > 0, F.col("s1") / F.col("n"))
    return summed.select("feature", F.col("period").alias("cut"), "n_rows", "n", "s", d.alias("d"),
                         F.greatest(F.col("s2") - F.col("n") * d * d, F.lit(0.0)).alias("m2"), "low", "high")


def prefix_statistics(df: DataFrame, cols: Sequence[str], period_col: str, cuts: Sequence,
                      inclusive: bool = False) -> DataFrame:
    """(cut, feature, n_rows, n_values, median, mean, scale): for each cut, over the rows
    of the periods before it (``inclusive``: up to it), the exact median of the finite
    values (ML1), and mean and population deviation with the other values replaced
    by that median (ML2; a constant column has scale 1).

    Every cut has a row for each feature; without a value in the part its median,
    mean and scale are null.  Rows without a period belong to no part; repeated cuts
    count once; no cuts, no features or an empty table give no rows.
    """
    cuts = sorted(set(cuts))
    if not cuts or not cols:
        kind = df.select(col_ref(period_col)).schema[0].dataType.simpleString()
        return df.sparkSession.createDataFrame(
            [], f"cut {kind}, feature string, n_rows long, n_values long, median double, mean double, scale double")
    long = _long(df, list(dict.fromkeys(cols)), period_col)
    both = _moments(long, cuts, inclusive).join(_medians(long, cuts, inclusive), ["feature", "cut"], "left")
    missing, n, rows = F.col("n_rows") - F.col("n"), F.col("n"), F.col("n_rows")
    to_median = F.col("median") - F.col("s")
    d = (n * F.col("d") + missing * to_median) / rows
    m2 = F.col("m2") + n * F.pow(F.col("d") - d, 2) + missing * F.pow(to_median - d, 2)
    return both.select(
        "cut", "feature", "n_rows", F.col("n").alias("n_values"), "median",
        F.when(n > 0, F.col("s") + d).alias("mean"),
        F.when(n > 0, F.when((F.col("low") == F.col("high")) | (m2 == 0), 1.0).otherwise(F.sqrt(m2 / rows))).alias("scale"))


@dataclass
class PreparedPrefixes:
    """Training parts that are prefixes of the periods: their rows kept once, and the
    medians and scales of all."""
    rows: DataFrame
    period: str
    features: list[str]
    inclusive: bool
    stats: dict

    def part(self, cut) -> Prepared:
        """The part of one cut, ready for any number of fits; nothing of its own to release."""
        found = self.stats[cut]
        imputer = MedianImputer({f: found[f]["median"] for f in self.features if found[f]["median"] is not None},
                                [f for f in self.features if found[f]["median"] is None])
        kept = [f for f in self.features if f not in imputer.dropped]
        scaler = Scaler({f: found[f]["scale"] for f in kept}, {f: found[f]["mean"] for f in kept})
        train = self.rows.where(_in_part(F.col(self.period), F.lit(cut), self.inclusive)).drop(self.period)
        return Prepared(train, kept, imputer, scaler, max(r["n_rows"] for r in found.values()))

    def release(self) -> None:
        self.rows.unpersist()


def prepare_prefixes(table: DataFrame, features: Sequence[str], label_col: str, period_col: str, cuts: Sequence,
                     inclusive: bool = False) -> PreparedPrefixes:
    """What :func:`prepare` gives for one training part, for all cuts in one go."""
    features = list(dict.fromkeys(features))
    y = F.coalesce(col_ref(label_col).try_cast("double"), F.lit(0.0))
    period = O.fresh("__period", table)
    rows = table.select(*[col_ref(c) for c in features], F.when(y > 0, 1.0).otherwise(0.0).alias("__label"),
                        col_ref(period_col).alias(period)).persist(StorageLevel.MEMORY_AND_DISK)
    stats: dict = {}
    # one row per cut and feature
    for r in prefix_statistics(rows, features, period, cuts, inclusive).collect():
        stats.setdefault(r["cut"], {})[r["feature"]] = r
    return PreparedPrefixes(rows, period, features, inclusive, stats)
