"""Profiles of tables and detectors of leaks, each as aggregates over the whole table."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..functions.bands import bin_right_closed
from ..functions.scalar import matched, safe_corr, safe_div, with_scalars
from ..session import split_settings
from ..sources import specs
from .features import pct_change
from .ordered import column_quantiles, quantiles, row_position

AGGREGATES_PER_PASS = 400


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def unpivot(row: DataFrame, names: list[str], value: str, key: str = "column") -> DataFrame:
    """One row with a column per name becomes one row per name."""
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return row.selectExpr(f"stack({len(names)}, {pairs}) AS (`{key}`, `{value}`)")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every value of the given columns as (column, value, n); NULL is a value."""
    entries = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("string").alias("value")) for n in columns])
    return (
        df.select(F.explode(entries).alias("e")).select("e.column", "e.value")
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def top_values(counts: DataFrame, k: int, by: str = "column") -> DataFrame:
    """The k most frequent values per column with their rank; ties by value.

    A column may have any number of values, so each is first cut into hash buckets and only the
    best k of every bucket meet in one window.
    """
    buckets = max(split_settings(counts.sparkSession).partitions, 8)
    best = [F.col("n").desc(), F.col("value").asc_nulls_last()]
    spread = counts.withColumn("_bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)))
    first = spread.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*best))).filter(F.col("_r") <= k)
    return (
        first.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*best)))
        .filter(F.col("rank") <= k).drop("_r", "_bucket")
    )


# ----------------------------------------------------------------------------------------------
# Profiles
# ----------------------------------------------------------------------------------------------
def column_profile(df: DataFrame, max_top_values: int = 5) -> DataFrame:
    """Type, missing values, distinct values, range, moments and most frequent values per column."""
    numeric = set(numeric_columns(df))
    times = {f.name for f in df.schema.fields if is_time(f.dataType)}
    nothing = F.lit(None).cast("double")
    cells = []
    for f in df.schema.fields:
        n, x = f.name, F.col(f.name)
        as_number = (lambda fn: fn(x.cast("double"))) if n in numeric else (lambda fn: nothing)  # noqa: B023
        as_time = (lambda fn: fn(x.cast("timestamp_ntz"))) if n in times else (lambda fn: F.lit(None).cast("timestamp_ntz"))  # noqa: B023
        cells.append(F.struct(
            F.lit(n).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.count(F.lit(1)).alias("rows"), F.count_if(x.isNull()).alias("missing"),
            as_number(F.min).alias("min"), as_number(F.max).alias("max"), as_number(F.avg).alias("mean"),
            as_number(F.stddev_samp).alias("std"), as_time(F.min).alias("first"), as_time(F.max).alias("last"),
            F.lit(n in numeric).alias("_numeric"), F.lit(n in times).alias("_time"),
        ).alias(n))
    moments = df.agg(*cells).select(F.explode(F.array(*df.columns)).alias("m")).select("m.*")
    counts = value_counts(df, df.columns).filter(F.col("value").isNotNull())
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    listed = (
        top_values(counts, max_top_values).groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("rank", F.concat("value", F.lit("="), "n").alias("text")))).alias("t"))
        .select("column", F.concat_ws(", ", F.transform("t", lambda e: e["text"])).alias("top_values"))
    )
    out = moments.join(distinct, "column", "left").join(listed, "column", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))
    shown = (~F.col("_time")) & (~F.col("_numeric") | (F.col("n_unique") <= 12))
    return out.select(
        "column", "dtype", "missing", (safe_div("missing", "rows") * 100).alias("missing_pct"), "n_unique",
        (safe_div("n_unique", "rows") * 100).alias("unique_pct"), "min", "max", "mean", "std", "first", "last",
        F.when(shown, F.coalesce("top_values", F.lit(""))).otherwise("").alias("top_values"),
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Counts and shares per class and the ratio of the largest to the smallest."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_n"), F.max("count").alias("_hi"), F.min("count").alias("_lo"), F.count(F.lit(1)).alias("_k"))
    return with_scalars(counts, total).select(
        target, "count", (F.col("count") / F.col("_n")).alias("proportion"),
        F.when(F.col("_k") >= 2, F.col("_hi") / F.col("_lo")).alias("imbalance_ratio"),
    )


def group_rate(df: DataFrame, group: str, target: str) -> DataFrame:
    """Rows, events and event rate per category."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(target).cast("bigint").alias("n_events"), F.avg(target).alias("event_rate"))


def decile_lift(df: DataFrame, feature: str, target: str, n_bins: int = 10) -> DataFrame:
    """Event rate and lift per quantile bin; bins are right-closed and equal edges merge."""
    rows = df.select(feature, target).dropna()
    edges = sorted(set(quantiles(rows, feature, [i / n_bins for i in range(n_bins + 1)])))
    bins = rows.groupBy(bin_right_closed(feature, edges).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(target).cast("bigint").alias("n_events"), F.avg(target).alias("event_rate"))
    base = bins.agg((F.sum("n_events") / F.sum("n")).alias("_base"))
    return with_scalars(bins, base).withColumn("lift", safe_div("event_rate", "_base")).drop("_base")


def temporal_rate(df: DataFrame, time: str, target: str) -> DataFrame:
    """Event rate per calendar month, empty months included."""
    rows = df.select(F.to_date(F.date_trunc("month", F.col(time))).alias("month"), target).dropna()
    monthly = rows.groupBy("month").agg(
        F.count(F.lit(1)).alias("n"), F.sum(target).cast("bigint").alias("n_events"), F.avg(target).alias("event_rate"))
    spine = monthly.agg(F.min("month").alias("a"), F.max("month").alias("b")).filter("a IS NOT NULL").select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    filled = spine.join(monthly, "month", "left")
    return filled.select(
        F.last_day("month").alias("period_end"), F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("n_events", F.lit(0)).alias("n_events"), "event_rate")


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, moments, tail percentiles and bias-corrected skew and kurtosis per column."""
    names = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    spark = df.sparkSession
    total = df.count()
    small = total <= split_settings(spark).min_rows
    large = {} if small else column_quantiles(df, columns, list(names.values()), total)
    cells = []
    for name in columns:
        x = F.col(name).cast("double")
        points = F.percentile(x, F.lit(list(names.values()))) if small else F.lit(large[name] or [None] * len(names)).cast("array<double>")
        n, g1, g2 = F.count(x).cast("double"), F.skewness(x), F.kurtosis(x)
        cells.append(F.struct(
            F.lit(name).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), points.alias("points"), F.max(x).alias("max"),
            F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
            F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurtosis"),
        ).alias(name))
    long = df.agg(*cells).select(F.explode(F.array(*columns)).alias("s")).select("s.*")
    return long.select(
        "column", "count", "mean", "std", "min", *[F.col("points")[i].alias(n) for i, n in enumerate(names)], "max", "skew", "kurtosis")


def mean_distinct_per_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean over groups of the number of distinct values."""
    pairs = df.select(group, value).filter(F.col(value).isNotNull()).distinct()
    per_group = df.select(group).distinct().join(pairs.groupBy(group).agg(F.count(F.lit(1)).alias("k")), group, "left")
    return per_group.agg(F.count(F.lit(1)).alias("n_groups"), F.avg(F.coalesce("k", F.lit(0))).alias("mean_distinct"))


# ----------------------------------------------------------------------------------------------
# Schema checks
# ----------------------------------------------------------------------------------------------
def missingness(df: DataFrame) -> DataFrame:
    return unpivot(df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in df.columns]), df.columns, "missing")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier one.

    Only a hash of each row is shuffled at first; whole rows are compared where a hash repeats.
    """
    hashed = df.withColumn("_h", F.xxhash64(*df.columns))
    repeated = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("_h")
    groups = hashed.join(repeated, "_h", "left_semi").groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_k"))
    return groups.agg(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).alias("n_duplicates"))


def key_uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key column: rows, distinct values and whether it identifies a row."""
    parts = []
    for k in keys:
        counts = df.groupBy(k).agg(F.count(F.lit(1)).alias("c"))
        parts.append(counts.agg(
            F.lit(k).alias("column"), F.sum("c").alias("n"), F.count(k).alias("n_distinct"), (F.max("c") == 1).alias("is_unique")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def temporal_span(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count_distinct(time).alias("n_distinct"), F.count(F.lit(1)).alias("n"))


def entity_overlap(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Number of keys each pair of tables shares, for every ordered pair.

    Each key carries the set of tables it occurs in; a set has at most as many entries as there
    are tables, so no join of keys with keys is needed.
    """
    tagged = None
    for name, (df, column) in tables.items():
        part = df.select(F.col(column).cast("string").alias("key"), F.lit(name).alias("t")).distinct()
        tagged = part if tagged is None else tagged.unionByName(part)
    sets = tagged.filter("key IS NOT NULL").groupBy("key").agg(F.collect_set("t").alias("ts"))
    patterns = sets.groupBy(F.array_sort("ts").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    pairs = patterns.select(F.explode("ts").alias("left_table"), "ts", "n").select("left_table", F.explode("ts").alias("right_table"), "n")
    found = pairs.groupBy("left_table", "right_table").agg(F.sum("n").alias("n_shared"))
    names = tables.keys()
    grid = tagged.sparkSession.createDataFrame(list(itertools.product(names, names)), "left_table string, right_table string")
    return grid.join(found, ["left_table", "right_table"], "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))


# ----------------------------------------------------------------------------------------------
# Leak detectors
# ----------------------------------------------------------------------------------------------
def near_constant(df: DataFrame, exclude: set[str] = frozenset(), threshold: float = specs.CONSTANT_CV) -> DataFrame:
    """Numeric columns whose standard deviation is tiny against their mean."""
    names = [n for n in numeric_columns(df) if n not in exclude]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, cv double")
    row = df.agg(*[safe_div(F.stddev_samp(F.col(n).cast("double")), F.abs(F.avg(n))).alias(n) for n in names])
    return unpivot(row, names, "cv").filter(F.col("cv") < threshold)


def identity_scan(
    df: DataFrame, exclude: set[str] = frozenset(), prefer: set[str] = frozenset(), tolerance: float = specs.IDENTITY_TOLERANCE, probe_rows: int = 500,
) -> DataFrame:
    """Columns that equal the sum or difference of two others on every row.

    Differences are sums told the other way round, so only "total = part + part" is looked for, among any number of columns.
    Some rows picked by hash refute most candidates; the rest are tested on the whole table, so the result is exact. A
    relation is told about its first column, or its first preferred one.
    """
    names = [n for n in numeric_columns(df) if n not in exclude]
    numbers = df.select(*[F.col(n).cast("double").alias(n) for n in names])
    schema = "subject string, left_operand string, operator string, right_operand string, max_residual double"
    if len(names) < 3:
        return df.sparkSession.createDataFrame([], schema)
    probe = np.array([list(r[:-1]) for r in numbers.withColumn("_h", F.xxhash64(*names)).orderBy("_h").limit(probe_rows).collect()], dtype=float).reshape(-1, len(names))
    open_sums = []
    for i, j in itertools.combinations(range(len(names)), 2):
        off = np.abs(probe - (probe[:, i] + probe[:, j])[:, None])
        worst = np.where(np.isnan(off), 0.0, off).max(axis=0, initial=0.0)
        open_sums += [(names[t], names[i], names[j]) for t in range(len(names)) if t not in (i, j) and worst[t] <= tolerance]
    found = []
    for start in range(0, len(open_sums), AGGREGATES_PER_PASS):
        part = open_sums[start : start + AGGREGATES_PER_PASS]
        row = numbers.agg(*[F.max(F.abs(F.col(t) - (F.col(a) + F.col(b)))).alias(f"r{k}") for k, (t, a, b) in enumerate(part)]).first()
        found += [(_told(*s, names, prefer), row[k]) for k, s in enumerate(part) if row[k] is not None and row[k] <= tolerance]
    found.sort(key=lambda x: names.index(x[0][0]))
    return df.sparkSession.createDataFrame([(*told, float(r)) for told, r in found], schema)


def _told(total: str, a: str, b: str, names: list[str], prefer: set[str]) -> tuple[str, str, str, str]:
    """The relation total = a + b as a statement about one of its columns."""
    subject = min((total, a, b), key=lambda n: (n not in prefer, names.index(n)))
    return (total, a, "+", b) if subject == total else (subject, total, "-", b if subject == a else a)


def with_class_codes(df: DataFrame, target: str, name: str) -> DataFrame:
    """Ordinal code of a class label: its place among the sorted labels; -1 for a missing one. For any number of labels."""
    labels = row_position(df.select(target).filter(F.col(target).isNotNull()).distinct(), [target], "_code")
    return matched(df, labels, [target], "left").withColumn(name, F.coalesce("_code", F.lit(-1))).drop("_code")


def target_correlation(df: DataFrame, target: str, exclude: set[str] = frozenset()) -> DataFrame:
    """Pearson correlation of every numeric column with the target, in one pass."""
    numeric = numeric_columns(df)
    if target in numeric:
        df = df.withColumn("_y", F.col(target))
    else:
        df = with_class_codes(df, target, "_y")
    names = [n for n in numeric if n != target and n not in exclude]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, corr double")
    numbers = df.select(*[F.col(n).cast("double").alias(n) for n in names], F.col("_y").cast("double").alias("_y"))
    row = numbers.agg(*[safe_corr(n, "_y").alias(n) for n in names])
    return unpivot(row, names, "corr").filter("corr IS NOT NULL")  # a constant column has none


def target_aliases(df: DataFrame, target: str, exclude: set[str] = frozenset(), threshold: float = specs.ALIAS_CORRELATION) -> DataFrame:
    return target_correlation(df, target, exclude).filter(F.abs("corr") >= threshold)


def correlation_ranking(df: DataFrame, target: str, top: int = 15, exclude: set[str] = frozenset()) -> DataFrame:
    return target_correlation(df, target, exclude).orderBy(F.abs("corr").desc(), "column").limit(top)


def label_reconstruction(df: DataFrame, target: str, columns: list[str], max_classes: int = 1000) -> DataFrame:
    """Share of labels that cuts of a column at the class shares bring back, per column, in one pass over all columns.

    ``max_classes`` bounds what is told the driver; a target with more values is no class label, which is an error.
    """
    spark = df.sparkSession
    schema = "column string, agreement double"
    shares = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    shares = sorted((r[0], r["n"]) for r in shares.limit(max_classes + 1).collect())
    if len(shares) > max_classes:
        raise ValueError(f"{target} has more than {max_classes} values and is not a class label")
    if len(shares) < 2 or not columns:
        return spark.createDataFrame([], schema)
    total = sum(n for _, n in shares)
    cumulative = [sum(n for _, n in shares[: i + 1]) / total for i in range(len(shares) - 1)]
    cuts = column_quantiles(df, columns, cumulative, total)
    reached = lambda n: F.size(F.filter(F.lit([float(e) for e in cuts[n]]), lambda e: e <= F.col(n).cast("double")))
    binned = [F.struct(F.lit(n).alias("column"), F.when(F.col(n).isNull(), len(cuts[n])).otherwise(reached(n)).alias("bin")) for n in columns]
    cells = df.select(F.col(target).alias("label"), F.explode(F.array(*binned)).alias("x")).groupBy("x.column", "x.bin", "label").agg(F.count(F.lit(1)).alias("n"))
    modal = cells.groupBy("column", "bin").agg(F.max(F.when(F.col("label").isNotNull(), F.col("n"))).alias("hit"), F.sum("n").alias("n"))
    return modal.groupBy("column").agg((F.sum("hit") / F.sum("n")).alias("agreement"))


def same_row_derivation(df: DataFrame, target: str, by: list[str], order: list[str], price: str) -> DataFrame:
    """Correlation of the target with the same row's price change; NULL below ten rows."""
    moved = pct_change(df, by, order, price, "_change").filter(F.col("_change").isNotNull() & F.col(target).isNotNull())
    return moved.agg(F.count(F.lit(1)).alias("n"), safe_corr(target, "_change").alias("_c")).select(
        "n", F.when(F.col("n") >= 10, F.col("_c")).alias("corr"))


def auc_standard_error(n_positive: Column, n_negative: Column, auc: float = 0.70) -> Column:
    """Hanley-McNeil standard error of an AUC; infinite with fewer than two rows of a class."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    spread = F.lit(auc * (1 - auc)) + (n_positive - 1) * F.lit(q1 - auc * auc) + (n_negative - 1) * F.lit(q2 - auc * auc)
    return F.when((n_positive <= 1) | (n_negative <= 1), F.lit(math.inf)).otherwise(F.sqrt(spread / (n_positive * n_negative)))


def cv_power(df: DataFrame, target: str, folds: list[int], max_se: float = specs.MAX_FOLD_SE) -> DataFrame:
    """Whether a binary target supports each number of folds, by the error of one fold's AUC."""
    counts = df.agg(F.sum(F.col(target).cast("double")).alias("p"), F.count(F.lit(1)).alias("n"))
    spread = counts.select("p", "n", F.explode(F.lit(list(folds))).alias("n_splits"))
    pos, neg = F.col("p") / F.col("n_splits"), (F.col("n") - F.col("p")) / F.col("n_splits")
    se = auc_standard_error(pos, neg)
    return spread.select(
        "n_splits", pos.alias("positives_per_fold"), se.alias("standard_error"), (se * 1.96).alias("half_interval"), (se <= max_se).alias("passes"))


def signal_strength(df: DataFrame, spec: specs.TableSpec, correlations: DataFrame | None = None) -> DataFrame:
    """Strongest correlation with the target among columns a model may use."""
    ranked = correlations if correlations is not None else target_correlation(df, spec.target, spec.forbidden_features)
    ranked = ranked.filter(~F.col("column").isin(sorted(spec.forbidden_features)))
    return ranked.agg(F.max(F.abs("corr")).alias("strongest"), F.max_by("column", F.struct(F.abs("corr"), "column")).alias("column")).withColumn(
        "severity", F.when(F.col("strongest") < specs.WEAK_SIGNAL, "HIGH").otherwise("INFO"))


# ----------------------------------------------------------------------------------------------
# Report
# ----------------------------------------------------------------------------------------------
def _finding(df: DataFrame, dataset: str, check: str, severity: Column, columns: Column, evidence: dict[str, Column], message: Column) -> DataFrame:
    entries = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("double"))]
    measured = F.create_map(*entries) if entries else F.create_map().cast("map<string,double>")
    return df.select(
        F.lit(dataset).alias("dataset"), F.lit(check).alias("check"), severity.alias("severity"),
        columns.cast("array<string>").alias("columns"), measured.alias("evidence"), message.alias("message"))


def findings(df: DataFrame, spec: specs.TableSpec, n_splits: int = 5, price: str | None = None) -> DataFrame:
    """Every check of one table as rows; a leak already declared in the contract is only INFO."""
    keys = {*spec.id_columns, *([spec.group_column] if spec.group_column else [])}
    declared = F.lit([n for n in df.columns if spec.is_declared_leak(n)]).cast("array<string>")
    leak = lambda c: F.when(F.array_contains(declared, c), "INFO").otherwise("CRITICAL")
    name, target = spec.key, spec.target
    one = F.array(F.col("column"))
    has_target = target in df.columns

    gaps = missingness(df).agg(
        F.count_if(F.col("missing") > 0).alias("k"), F.collect_list(F.when(F.col("missing") > 0, F.col("column"))).alias("cols"),
        F.sum("missing").alias("total"))
    parts = [
        _finding(gaps, name, "missingness", F.when(F.col("k") > 0, "HIGH").otherwise("INFO"), F.col("cols"),
                 {"columns": F.col("k"), "missing": F.col("total")}, F.concat(F.col("k"), F.lit(" column(s) with missing values"))),
        _finding(duplicate_rows(df), name, "duplicates", F.when(F.col("n_duplicates") > 0, "HIGH").otherwise("INFO"), F.array(),
                 {"n_duplicates": F.col("n_duplicates")}, F.concat(F.col("n_duplicates"), F.lit(" duplicate row(s)"))),
        _finding(near_constant(df, keys), name, "near_constant",
                 F.when(F.col("column").isin(target, *spec.other_targets), "HIGH").otherwise("INFO"), one, {"cv": F.col("cv")},
                 F.concat(F.col("column"), F.lit(" is effectively constant"))),
        _finding(identity_scan(df, keys, set(spec.drop_always)), name, "arithmetic_identity", leak(F.col("subject")),
                 F.array("subject", "left_operand", "right_operand"), {"max_residual": F.col("max_residual")},
                 F.concat_ws(" ", "subject", F.lit("="), "left_operand", "operator", "right_operand")),
    ]
    ids = [k for k in spec.id_columns if k in df.columns]
    if ids:
        parts.append(_finding(key_uniqueness(df, ids).filter("is_unique"), name, "identifier", F.lit("INFO"), one,
                              {"n": F.col("n")}, F.concat(F.col("column"), F.lit(" identifies a row"))))
    if has_target:
        # One pass serves both checks; its result has one row per column.
        measured = target_correlation(df, target, set(spec.id_columns))
        measured = df.sparkSession.createDataFrame(measured.collect(), "column string, corr double")
        strength = signal_strength(df, spec, measured).filter("strongest IS NOT NULL")
        parts += [
            _finding(measured.filter(F.abs("corr") >= specs.ALIAS_CORRELATION), name, "target_alias", leak(F.col("column")), one,
                     {"corr": F.col("corr")}, F.concat(F.col("column"), F.lit(" follows the target"))),
            _finding(strength, name, "signal_strength", F.col("severity"), one, {"strongest": F.col("strongest")},
                     F.concat(F.lit("strongest admissible column is "), F.col("column"))),
        ]
    if has_target and spec.task.endswith("classification"):
        balance = class_balance(df, target).agg(F.count(F.lit(1)).alias("k"), F.max("imbalance_ratio").alias("r"))
        parts.append(_finding(balance, name, "class_balance", F.lit("INFO"), F.array(F.lit(target)),
                              {"classes": F.col("k"), "imbalance_ratio": F.col("r")}, F.concat(F.col("k"), F.lit(" classes"))))
        if target not in numeric_columns(df):
            candidates = [n for n in numeric_columns(df) if n not in spec.id_columns]
            cuts = label_reconstruction(df, target, candidates).filter(F.col("agreement") >= specs.MIN_AGREEMENT)
            parts.append(_finding(cuts, name, "label_reconstruction", leak(F.col("column")), one, {"agreement": F.col("agreement")},
                                  F.concat(F.lit("cuts of "), F.col("column"), F.lit(" bring back the label"))))
        elif spec.task.startswith("binary"):
            power = cv_power(df, target, [n_splits])
            parts.append(_finding(power, name, "cv_power", F.when(F.col("passes"), "INFO").otherwise("HIGH"), F.array(F.lit(target)),
                                  {"standard_error": F.col("standard_error")}, F.concat(F.col("n_splits"), F.lit(" folds"))))
    times = [c for c in spec.datetime_columns if c in df.columns]
    if times:
        span = temporal_span(df, times[0])
        parts.append(_finding(span, name, "temporal_structure", F.lit("INFO"), F.array(F.lit(times[0])), {"n_distinct": F.col("n_distinct")},
                              F.concat(F.col("first").cast("string"), F.lit(" to "), F.col("last").cast("string"))))
    if price and times and has_target:
        derived = same_row_derivation(df, target, list(spec.id_columns), times[:1], price).filter(F.abs("corr") > specs.ALIAS_CORRELATION)
        parts.append(_finding(derived, name, "same_row_derivation", leak(F.lit(target)), F.array(F.lit(target), F.lit(price)),
                              {"corr": F.col("corr")}, F.lit("the target repeats the change of the price on its own row")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def raise_if_critical(report: DataFrame) -> None:
    """Stop when a leak is found that the contract does not declare."""
    bad = report.filter("severity = 'CRITICAL'").select("dataset", "check", "message").collect()  # a few per column
    if bad:
        raise ValueError("undeclared leaks: " + "; ".join(f"{r.dataset}/{r.check}: {r.message}" for r in bad))
