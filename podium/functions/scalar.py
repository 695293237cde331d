"""Scalar column expressions (P1, P3, P4, P7, P12, P14, P15, P17) and the NaN
guard (trap T1).  All are native Spark expressions: no Python per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(f"`{c}`") if not str(c).startswith("`") else F.col(c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every float/double column, in one projection."""
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not fl:
        return df
    return df.select(*[
        F.nanvl(_c(f.name), F.lit(None).cast(f.dataType)).alias(f.name) if f.name in fl else _c(f.name)
        for f in df.schema.fields])


def to_number(c) -> Column:
    """Numeric coercion; text that is not a number becomes NULL."""
    return F.expr(f"try_cast({_sql_ref(c)} as double)") if not isinstance(c, Column) else _try_double(c)


def _try_double(col: Column) -> Column:
    return col.try_cast("double")


def _sql_ref(name: str) -> str:
    return "`" + str(name).replace("`", "``") + "`"


def parse_season_end(c) -> Column:
    """Period end year from ``2026``, ``'2025-26'`` or ``'2025-2026'``;
    anything else is NULL.  ``'1999-00'`` gives 2000 (decision D1: when the
    two-digit suffix is the start year + 1, the end year is start + 1; other
    two-digit suffixes keep the start's century)."""
    s = F.trim(_c(c).cast("string"))
    head = F.trim(F.regexp_extract(s, r"^([^-]*)-(.*)$", 1))
    tail = F.trim(F.regexp_extract(s, r"^([^-]*)-(.*)$", 2))
    has_dash = s.contains("-")
    start = head.try_cast("int")
    short_ok = has_dash & head.rlike(r"^[0-9]{4}$") & tail.rlike(r"^[0-9]{2}$")
    long_ok = has_dash & tail.rlike(r"^[0-9]{4}$")
    next_suffix = (start + F.lit(1)) % F.lit(100)
    short_year = F.when(tail.try_cast("int") == next_suffix, start + F.lit(1)).otherwise(
        F.concat(F.substring(head, 1, 2), tail).try_cast("int"))
    return (F.when(s.isNull() | (s == ""), F.lit(None).cast("int"))
            .when(s.rlike(r"^[0-9]+$"), s.try_cast("int"))
            .when(short_ok, short_year)
            .when(long_ok, tail.try_cast("int"))
            .otherwise(F.lit(None).cast("int")))


def season_label(c) -> Column:
    """End year 2026 -> ``'2025-26'``."""
    y = _c(c).cast("int")
    return F.concat((y - 1).cast("string"), F.lit("-"), F.lpad((y % 100).cast("string"), 2, "0"))


def as_binary(c) -> Column:
    """Booleans become 0/1; otherwise numeric value > 0 is 1, anything else
    (including NULL and non-numbers) is 0."""
    return F.coalesce(_c(c).try_cast("double") > F.lit(0.0), F.lit(False)).cast("int")


def inf_to_null(c) -> Column:
    """+-infinity and NaN become NULL."""
    x = _c(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def map_values(c, mapping: Mapping) -> Column:
    """Recode values by a small literal map; unmapped values stay."""
    if not mapping:
        return _c(c)
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(m[_c(c)], _c(c))


def format_3dp(c) -> Column:
    """Three-decimal text, NULL -> empty string."""
    return F.coalesce(F.format_string("%.3f", _c(c).cast("double")), F.lit(""))


PROBA_EPS = 1e-6


def clip_probability(c, eps: float = PROBA_EPS) -> Column:
    """Clamp to [eps, 1 - eps] before a log loss."""
    return F.greatest(F.least(_c(c).cast("double"), F.lit(1.0 - eps)), F.lit(eps))


def safe_ratio(num, den) -> Column:
    """Division with a zero / NULL guard (NULL instead of an error)."""
    return F.try_divide(_c(num).cast("double"), F.nullif(_c(den).cast("double"), F.lit(0.0)))


col_ref = _c
