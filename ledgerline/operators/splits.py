"""Assignment of rows to folds, as columns, and the checks that folds do not leak.

A fold is described by positions on an ordered axis (dates, groups or rows).  ``positioned``
functions attach that axis once; roles are then plain comparisons, so no table of indexes is
built unless ``assign`` is asked for one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import uniform
from .ordered import causal, chunk_of, prior_count, row_position

AXIS = "_axis"


@dataclass(frozen=True)
class Fold:
    """Train rows lie below ``train_end``, test rows in [test_start, test_end)."""

    fold: int
    train_end: int
    test_start: int
    test_end: int

    def is_train(self, axis: str = AXIS) -> Column:
        return F.col(axis) < self.train_end

    def is_test(self, axis: str = AXIS) -> Column:
        return (F.col(axis) >= self.test_start) & (F.col(axis) < self.test_end)


def assign(df: DataFrame, folds: list[Fold], keep: list[str], axis: str = AXIS) -> DataFrame:
    """Long table (keep, fold, role) of every row's role in every fold it takes part in."""
    entries = [
        F.struct(F.lit(f.fold).alias("fold"), F.when(f.is_train(axis), "train").when(f.is_test(axis), "test").alias("role"))
        for f in folds
    ]
    return df.select(*keep, F.explode(F.array(*entries)).alias("_entry")).select(*keep, "_entry.fold", "_entry.role").filter("role IS NOT NULL")


# ----------------------------------------------------------------------------------------------
# Axes
# ----------------------------------------------------------------------------------------------
def value_axis(df: DataFrame, value: str) -> tuple[DataFrame, int]:
    """0-based place of each row's value among the distinct values, and how many there are."""
    distinct = df.select(value).filter(F.col(value).isNotNull()).distinct()
    placed = row_position(distinct, [value], AXIS)
    return df.join(placed, value), distinct.count()


def row_axis(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """0-based place of each row under a unique order."""
    return row_position(df, order, AXIS), df.count()


# ----------------------------------------------------------------------------------------------
# Chronological schemes
# ----------------------------------------------------------------------------------------------
def purged_walk_forward(df: DataFrame, date: str, n_splits: int = 5, embargo: int = 5, min_train: int = 60) -> tuple[DataFrame, list[Fold]]:
    """Growing train block of whole dates, an embargo of dates, then the test dates."""
    axis, n = value_axis(df, date)
    usable = n - min_train - embargo
    if usable < n_splits:
        raise ValueError(f"{n} dates cannot carry {n_splits} folds after {min_train} training and {embargo} embargo dates")
    return axis, _growing(n, n_splits, usable // n_splits, min_train, embargo)


def expanding_window(df: DataFrame, order: list[str], n_splits: int = 5, horizon: int = 5, min_train: int = 250) -> tuple[DataFrame, list[Fold]]:
    """Growing train block of rows with a gap as long as the forecast horizon."""
    axis, n = row_axis(df, order)
    usable = n - min_train - horizon
    if usable < n_splits:
        raise ValueError(f"{n} rows cannot carry {n_splits} folds after {min_train} training and {horizon} gap rows")
    return axis, [f for f in _growing(n, n_splits, usable // n_splits, min_train, horizon) if f.test_start < n]


def _growing(n: int, n_splits: int, size: int, first: int, gap: int) -> list[Fold]:
    out = []
    for i in range(n_splits):
        end = first + i * size
        last = n if i == n_splits - 1 else end + gap + size
        out.append(Fold(i + 1, end, end + gap, last))
    return out


def time_series_split(df: DataFrame, order: list[str], n_splits: int = 5) -> tuple[DataFrame, list[Fold]]:
    """Equal test blocks at the end of the axis, each trained on all rows before it."""
    axis, n = row_axis(df, order)
    size = n // (n_splits + 1)
    if size < 1:
        raise ValueError(f"{n} rows cannot carry {n_splits} folds")
    starts = [n - (n_splits - i) * size for i in range(n_splits)]
    return axis, [Fold(i + 1, s, s, s + size) for i, s in enumerate(starts)]


def walk_forward_by_group(
    df: DataFrame, group: str, order: list[str], train: int = 12, val: int = 4, test: int = 4, purge: int = 1,
) -> DataFrame:
    """Role of each row by whole groups in order; the last ``purge`` training rows get no role."""
    axis, n = value_axis(df, group)
    if n < train + val + test:
        raise ValueError(f"{n} groups, {train + val + test} needed")
    a = F.col(AXIS)
    role = F.when(a < train, "train").when(a < train + val, "validation").when(a < train + val + test, "test")
    out = axis.withColumn("role", role)
    if purge:
        last = [F.col(c).desc() for c in (group, *order)]
        dropped = out.filter("role = 'train'").orderBy(*last).limit(purge).select(*order)
        dropped = dropped.withColumn("_purged", F.lit(True))
        out = out.join(F.broadcast(dropped), order, "left")  # at most ``purge`` rows
        out = out.withColumn("role", F.when(F.col("_purged").isNull(), F.col("role"))).drop("_purged")
    return out.filter("role IS NOT NULL").drop(AXIS)


def holdout_by_time(df: DataFrame, time: str, cut) -> DataFrame:
    """Train rows before the cut, hold-out rows from it on."""
    out = df.withColumn("role", F.when(F.col(time) < F.lit(cut), "train").when(F.col(time) >= F.lit(cut), "holdout"))
    if out.filter("role = 'holdout'").limit(1).count() == 0:
        raise ValueError(f"no rows on or after {cut}")
    return out


# ----------------------------------------------------------------------------------------------
# Shuffled schemes
# ----------------------------------------------------------------------------------------------
def stratified_folds(df: DataFrame, key: str, label: str, n_splits: int = 5, repeats: int = 1, seed: int = 42) -> DataFrame:
    """Fold of each row per repeat; every fold gets the same share of each class.

    The repeat is part of the key of the result, so a row keeps one fold per repeat.
    """
    rows = df.select(key, label).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    rows = rows.withColumn("_u", uniform(key, "repeat", seed))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    placed = causal(rows, [label, "repeat"], ["_u", key], {"_at": prior_count()})
    joined = placed.join(sizes.withColumnRenamed(label, "_l"), F.col(label).eqNullSafe(F.col("_l")))
    return joined.select(key, label, "repeat", chunk_of(F.col("_at"), F.col("_n"), n_splits).alias("fold"))


def group_fold(groups: list[str], n_splits: int = 5, seed: int = 42) -> Column:
    """Fold of a row by all of its group columns; a group is never divided."""
    return (F.floor(uniform(*groups, seed) * n_splits) + 1).cast("int")


# ----------------------------------------------------------------------------------------------
# Checks
# ----------------------------------------------------------------------------------------------
def temporal_overlap(assigned: DataFrame, time: str, embargo: int = 0) -> DataFrame:
    """Folds whose train rows reach into the test period or too close to it.

    The gap is counted in distinct dates that lie between the blocks and belong to neither.
    """
    edges = assigned.groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col(time))).alias("train_end"),
        F.min(F.when(F.col("role") != "train", F.col(time))).alias("test_start"))
    bad = edges.filter(F.col("train_end") >= F.col("test_start")).withColumn("gap", F.lit(0).cast("bigint"))
    if not embargo:
        return bad
    dates = assigned.select(time).distinct()
    between = edges.join(dates, (F.col(time) > F.col("train_end")) & (F.col(time) < F.col("test_start")), "left")
    gaps = between.groupBy("fold", "train_end", "test_start").agg(F.count(time).alias("gap"))
    return gaps.filter((F.col("train_end") >= F.col("test_start")) | (F.col("gap") < embargo))


def group_overlap(assigned: DataFrame, groups: list[str]) -> DataFrame:
    """Groups that appear in more than one role of a fold."""
    roles = assigned.groupBy("fold", *groups).agg(F.min("role").alias("a"), F.max("role").alias("b"))
    return roles.filter(F.col("a") != F.col("b")).select("fold", *groups)


def describe_folds(assigned: DataFrame, time: str) -> DataFrame:
    """Sizes, boundaries and gap of every fold."""
    train = F.col("role") == "train"
    out = assigned.groupBy("fold").agg(
        F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"),
        F.max(F.when(train, F.col(time))).alias("train_end"), F.min(F.when(~train, F.col(time))).alias("test_start"),
        F.max(F.when(~train, F.col(time))).alias("test_end"))
    return out.withColumn("gap_days", F.datediff("test_start", "train_end"))


def coverage(assigned: DataFrame, key: str) -> DataFrame:
    """Keys that are not tested exactly once."""
    tests = F.count_if(F.col("role") != "train")
    return assigned.groupBy(key).agg(tests.alias("n_tests")).filter("n_tests <> 1")
