"""The list of queries: a Spark callable per name and, where SQL can express it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .views import NUDGE, Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: dict[str, int] | None = None):
    """Register ``fn(tables) -> DataFrame``.

    ``digits`` names the double columns of the result and how far they are rounded; the same
    rounding is put around the SQL.
    """
    digits = digits or {}

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Tables(spark, sf_dir)), digits)

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            replaced = ", ".join(f"round({c} + {NUDGE}, {d}) AS {c}" for c, d in digits.items())
            body = sql.strip()
            replace = f" REPLACE ({replaced})" if replaced else ""
            ORACLES[name] = with_views(f"SELECT *{replace} FROM (\n{body}\n)")
        return fn

    return wrap


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in digits:
            raise ValueError(f"no rounding given for {f.name}")
    return df.select(*[
        F.round(F.col(c) + F.lit(NUDGE), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns
    ])
