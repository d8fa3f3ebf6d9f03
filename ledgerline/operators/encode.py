"""Leak-safe encodings of categories and the filters that choose features."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import safe_corr, uniform, with_scalars
from .audit import AGGREGATES_PER_PASS, is_time, numeric_columns, unpivot, value_counts


def column_kinds(df: DataFrame, max_cardinality: int = 50, approximate: bool = False) -> DataFrame:
    """Numeric, low- or high-cardinality kind of each column; date and time columns are left out."""
    numeric = set(numeric_columns(df))
    text = [f.name for f in df.schema.fields if f.name not in numeric and not is_time(f.dataType)]
    counter = F.approx_count_distinct if approximate else F.count_distinct
    spark = df.sparkSession
    out = spark.createDataFrame([(n, "numeric", None) for n in df.columns if n in numeric], "column string, kind string, n_distinct bigint")
    if text:
        long = unpivot(df.agg(*[counter(n).alias(n) for n in text]), text, "n_distinct")
        kind = F.when(F.col("n_distinct") <= max_cardinality, "low_cardinality").otherwise("high_cardinality")
        out = out.unionByName(long.select("column", kind.alias("kind"), "n_distinct"))
    return out


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, name: str, default: Column) -> DataFrame:
    """Attach ``value`` of the matching row of ``table``; a key not in it gets the default.

    The lookup table is as large as the number of categories, so Spark chooses how to join.
    """
    side = table.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    joined = df.join(side, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn(name, F.coalesce("_value", default)).drop("_key", "_value")


def frequency_table(train: DataFrame, category: str) -> DataFrame:
    """Share of each category among the training rows."""
    counts = train.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return with_scalars(counts, total).select(category, (F.col("n") / F.col("_t")).alias("frequency"))


def frequency_encode(df: DataFrame, train: DataFrame, category: str, name: str) -> DataFrame:
    return lookup(df, frequency_table(train, category), category, "frequency", name, F.lit(0.0))


def smoothed_means(train: DataFrame, category: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """Category means of the target pulled towards the overall mean; also the overall mean as ``prior``."""
    sums = train.groupBy(category).agg(F.count(target).alias("n"), F.sum(F.col(target).cast("double")).alias("s"))
    prior = sums.agg((F.sum("s") / F.sum("n")).alias("prior"))
    joined = with_scalars(sums, prior)
    return joined.select(category, "n", ((F.col("s") + F.lit(smoothing) * F.col("prior")) / (F.col("n") + smoothing)).alias("encoded"), "prior")


def target_encode(df: DataFrame, train: DataFrame, category: str, target: str, name: str, smoothing: float = 10.0) -> DataFrame:
    """Encode rows that were not part of training with the full training means."""
    means = smoothed_means(train, category, target, smoothing)
    prior = train.agg(F.avg(F.col(target).cast("double"))).collect()[0][0]
    return lookup(df, means, category, "encoded", name, F.lit(prior))


def out_of_fold_encode(
    df: DataFrame, category: str, target: str, fold: str, name: str, smoothing: float = 10.0,
) -> DataFrame:
    """Encode each row from the rows of all other folds.

    One aggregate per (category, fold) is enough: what the other folds hold is the category total
    minus the own fold.  Totals per category come from the same aggregate.
    """
    y = F.col(target).cast("double")
    cell = df.groupBy(category, fold).agg(F.count(target).alias("n"), F.sum(y).alias("s"))
    whole = cell.groupBy(category).agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    per_fold = cell.groupBy(fold).agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    grand = cell.agg(F.sum("n").alias("gn"), F.sum("s").alias("gs"))
    prior = with_scalars(per_fold, grand).select(
        F.col(fold).alias("_fold"), ((F.col("gs") - F.col("fs")) / (F.col("gn") - F.col("fn"))).alias("_prior"))
    rest = cell.join(whole.withColumnRenamed(category, "_c"), F.col(category).eqNullSafe(F.col("_c"))).select(
        F.col(category).alias("_cat"), F.col(fold).alias("_f"), (F.col("all_n") - F.col("n")).alias("_n"),
        (F.coalesce("all_s", F.lit(0.0)) - F.coalesce("s", F.lit(0.0))).alias("_s"))
    table = rest.join(prior, F.col("_f") == F.col("_fold")).select(
        "_cat", "_f", F.when(F.col("_n") > 0, (F.col("_s") + F.lit(smoothing) * F.col("_prior")) / (F.col("_n") + smoothing))
        .otherwise(F.col("_prior")).alias(name))
    joined = df.join(table, F.col(category).eqNullSafe(F.col("_cat")) & (F.col(fold) == F.col("_f")), "left")
    return joined.drop("_cat", "_f")


def hashed_fold(key: str, folds: int, seed: int) -> Column:
    """Fold number of a row, the same on every run."""
    return F.floor(uniform(key, seed) * folds).cast("int")


# ----------------------------------------------------------------------------------------------
# Feature filters
# ----------------------------------------------------------------------------------------------
def variance_filter(df: DataFrame, columns: list[str], threshold: float = 1e-8, dominance: float = 0.995) -> DataFrame:
    """Constant columns and columns ruled by one value, with the measures behind the verdict."""
    numeric = [n for n in numeric_columns(df) if n in columns]
    none = df.sparkSession.createDataFrame([], T.StructType.fromDDL("column string, variance double"))
    variance = unpivot(df.agg(*[F.var_pop(F.col(n).cast("double")).alias(n) for n in numeric]), numeric, "variance") if numeric else none
    share = value_counts(df, columns).groupBy("column").agg((F.max("n") / F.sum("n")).alias("top_share"))
    verdict = F.when(F.col("variance") <= threshold, "variance").when(F.col("top_share") >= dominance, "dominance").otherwise("kept")
    return share.join(variance, "column", "left").select("column", "variance", "top_share", verdict.alias("verdict"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns over their complete rows."""
    pairs = list(itertools.combinations(columns, 2))
    numbers = df.select(*[F.col(n).cast("double").alias(n) for n in columns])
    out = None
    for start in range(0, len(pairs), AGGREGATES_PER_PASS):
        part = pairs[start : start + AGGREGATES_PER_PASS]
        row = numbers.agg(*[safe_corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(part)])
        entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(part)]
        long = row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
        out = long if out is None else out.unionByName(long)
    return out


def correlation_filter(df: DataFrame, columns: list[str], threshold: float = 0.95, priority: set[str] = frozenset()) -> dict[str, str]:
    """Columns to drop and the kept column each repeats most.

    Columns are ranked once: preferred ones first, then those that resemble the others least, then by name. In that order a
    column is kept unless it correlates at the threshold or above with one already kept, so the ends of a chain both stay.
    The matrix is computed on Spark; its k x k numbers are ranked here.
    """
    matrix = {frozenset((r.a, r.b)): abs(r.corr or 0.0) for r in correlation_matrix(df, columns).collect()} if len(columns) > 1 else {}
    resemblance = {c: sum(v for pair, v in matrix.items() if c in pair) for c in columns}
    kept: list[str] = []
    repeats: dict[str, str] = {}
    for column in sorted(columns, key=lambda c: (c not in priority, resemblance[c], c)):
        like = {k: matrix[frozenset((k, column))] for k in kept}
        nearest = max(like, key=like.get, default=None)
        if nearest is None or like[nearest] < threshold:
            kept.append(column)
        else:
            repeats[column] = nearest
    return repeats
