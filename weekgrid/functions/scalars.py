"""Column expressions shared by the operators. All stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_date(c: str | Column) -> Column:
    """Text, timestamp or date to DATE; unreadable text becomes null instead of failing the job."""
    return F.coalesce(
        F.try_to_timestamp(col(c).cast("string")).cast("date"),
        F.try_to_timestamp(col(c).cast("string"), F.lit("yyyy/MM/dd")).cast("date"),
    )


def number(c: str | Column) -> Column:
    return col(c).try_cast("double")


def measure(c: str | Column) -> Column:
    """A numeric measure: unreadable, missing, NaN and infinite count as zero."""
    value = number(c)
    return F.coalesce(F.when(F.abs(value) < float("inf"), value), F.lit(0.0))  # NaN is above infinity


def monday(d: str | Column) -> Column:
    """Monday of the week that holds ``d``, without a trip through timestamps and time zones."""
    return F.date_sub(col(d), F.weekday(col(d)))


def day_number(d: str | Column) -> Column:
    return F.unix_date(col(d))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def slug(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[\s\-]+", "_"), "[^a-z0-9_]", "")


def position_group(c: str | Column) -> Column:
    p = F.lower(col(c))
    return (
        F.when(p.isNull(), "Unknown")
        .when(p.contains("goalkeeper"), "GK")
        .when(p.contains("defender") | p.contains("back"), "DEF")
        .when(p.contains("midfield"), "MID")
        .when(p.contains("attack") | p.contains("winger"), "FWD")
        .otherwise("Other")
    )


def range_label(low: str | Column, high: str | Column) -> Column:
    return F.format_string("%.0f-%.0f", col(low).cast("double"), col(high).cast("double"))


def contains_ci(c: str | Column, text: str) -> Column:
    return F.contains(F.lower(col(c)), F.lit(text.lower()))


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 when the denominator is 0 (ANSI mode would fail the job)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def stable_hash(keys: list[str], salt: object) -> Column:
    """A 52-bit hash that any SQL engine can reproduce: leading hex digits of an MD5 digest.

    Used wherever a draw must not depend on partitioning, so samples survive recomputation.
    """
    text = F.concat_ws("|", F.lit(str(salt)), *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


HASH_BITS = 52


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
