"""Small column expressions: safe arithmetic, missing values, hashing, calendar parts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """NaN and both infinities become NULL."""
    x = col(x)
    return F.when(F.abs(x) < F.lit(INFINITY), x)


def safe_div(numerator, denominator) -> Column:
    """Division that yields NULL for a zero denominator or a non-finite quotient."""
    return finite(F.try_divide(col(numerator).cast("double"), col(denominator).cast("double")))


def safe_corr(x, y) -> Column:
    """Pearson correlation over rows with both values; NULL if either side is constant.

    The built-in raises on a constant side under ANSI rules.
    """
    x, y = col(x).cast("double"), col(y).cast("double")
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return finite(F.try_divide(F.covar_pop(x, y), spread))


def flag(condition: Column) -> Column:
    """0/1 integer; an unknown comparison counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities by NULL in every floating column, once, at ingestion."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[finite(c).alias(c) if c in floats else F.col(c) for c in df.columns])


def seconds_between(later, earlier) -> Column:
    """Seconds between two timestamps with microsecond resolution."""
    micros = lambda c: F.unix_micros(col(c).cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def uniform(*parts) -> Column:
    """Deterministic uniform number in [0, 1) of 52 bits from the md5 of the joined parts."""
    text = F.concat_ws(":", *[col(p).cast("string") if not isinstance(p, (int, float)) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def weekday(x) -> Column:
    """Monday is 0."""
    return F.weekday(col(x))


def is_month_end(x) -> Column:
    day = col(x).cast("date")
    return flag(day == F.last_day(day))


def is_quarter_end(x) -> Column:
    day = col(x).cast("date")
    return flag((day == F.last_day(day)) & (F.month(day) % 3 == 0))


def quarter_label(x) -> Column:
    return F.concat(F.year(col(x)).cast("string"), F.lit("Q"), F.quarter(col(x)).cast("string"))


def cyclical(x, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * col(x) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def encode_cyclical(df: DataFrame, periods: dict[str, float]) -> DataFrame:
    """Replace each column by its sine and cosine over the given period."""
    added = {}
    for name, period in periods.items():
        added[f"{name}_sin"], added[f"{name}_cos"] = cyclical(name, period)
    return df.withColumns(added).drop(*periods)


def with_scalars(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table, the result of an ungrouped aggregate, to every row."""
    key = "_one"
    return df.withColumn(key, F.lit(0)).join(F.broadcast(totals.withColumn(key, F.lit(0))), key).drop(key)


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", broadcast: bool = False) -> DataFrame:
    """Join on columns of the same names where NULL matches NULL; the keys appear once, as those of ``left``."""
    if not keys:
        raise ValueError("no keys to join on")
    other = right.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_other_{k}"]) for k in keys])
    return left.join(F.broadcast(other) if broadcast else other, same, how).drop(*[f"_other_{k}" for k in keys])


def present_cash_flow(flows: list, rate: float) -> Column:
    """Discounted value of end-of-period flows."""
    return reduce(lambda a, b: a + b, [col(c) / F.lit((1 + rate) ** t) for t, c in enumerate(flows, start=1)])
