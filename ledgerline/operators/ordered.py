"""Ordered computations within groups that stay distributed when one group holds most rows.

A plain window sorts a whole group in one task.  Here a group that is larger than one task
should hold is cut along its order column at approximate quantiles.  Every slice is one window
partition; what a slice needs from its neighbours travels as

* a halo: the few rows before (lag, rolling) or after (lead) the slice, copied to it, and
* a prefix: sums, extremes and moments of all earlier slices, one row per slice.

Results are exact, only the cut points come from a sketch.  Sums of doubles depend on the order of addition; they are added
in blocks by row number, so they do not depend on the cut points either (see ``_in_blocks``).  All other groups use one plain
window, and a table below ``spark.ledgerline.minSplitRows`` rows costs no more than a count.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import col, matched, with_scalars
from ..session import materialise, split_settings

FIRST = Window.unboundedPreceding
#: Rows of a group whose doubles are added one after the other; sums of whole blocks are then added in order.
BLOCK = 500_000
STATS = ("mean", "std", "sum", "min", "max", "median", "count")


# ----------------------------------------------------------------------------------------------
# What may be asked of an ordered group
# ----------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Feature:
    kind: str
    column: str | None = None
    size: int = 0
    stat: str = ""
    min_periods: int = 1

    def __post_init__(self):
        if self.kind in ("lag", "lead", "rolling") and self.size < 1:
            raise ValueError(f"{self.kind} needs at least one row, got {self.size}")
        if self.kind in ("rolling", "expanding", "running") and self.stat not in STATS:
            raise ValueError(f"unknown statistic {self.stat!r}; choose one of {', '.join(STATS)}")


def lag(column: str, rows: int = 1) -> Feature:
    """Value that many rows earlier in the group."""
    return Feature("lag", column, rows)


def lead(column: str, rows: int = 1) -> Feature:
    """Value that many rows later; for targets only."""
    return Feature("lead", column, rows)


def rolling(column: str, rows: int, stat: str, min_periods: int = 1) -> Feature:
    """Statistic of the last ``rows`` rows strictly before the current one."""
    return Feature("rolling", column, rows, stat, min_periods)


def expanding(column: str, stat: str, min_periods: int = 1) -> Feature:
    """Statistic of all rows strictly before the current one."""
    return Feature("expanding", column, 0, stat, min_periods)


def running(column: str, stat: str) -> Feature:
    """Statistic of all rows up to and including the current one."""
    return Feature("running", column, 0, stat)


def prior_count() -> Feature:
    """Number of rows before the current one."""
    return Feature("position")


def _stat(name: str, c: Column) -> Column:
    return {
        "mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max,
        "count": F.count, "median": lambda x: F.percentile(x, 0.5),
    }[name](c)


def _plain(feature: Feature, window) -> Column:
    if feature.kind == "lag":
        return F.lag(feature.column, feature.size).over(window)
    if feature.kind == "lead":
        return F.lead(feature.column, feature.size).over(window)
    if feature.kind == "position":
        return (F.row_number().over(window) - 1).cast("bigint")
    frame = {
        "rolling": (-feature.size, -1), "expanding": (FIRST, -1), "running": (FIRST, 0),
    }[feature.kind]
    over = window.rowsBetween(*frame)
    value = _stat(feature.stat, F.col(feature.column)).over(over)
    if feature.min_periods > 1:
        value = F.when(F.count(feature.column).over(over) >= feature.min_periods, value)
    return value


# ----------------------------------------------------------------------------------------------
# Finding groups that need cutting
# ----------------------------------------------------------------------------------------------
@dataclass
class Cut:
    """Cut points of the groups above the size threshold.

    ``table`` has one row per such group: its key, ``_bounds`` (cut points) and ``_coarse``
    (every n-th cut point, for a two-step search).  There are at most 4 x partitions groups and,
    over all of them, at most about 12 x partitions cut points, whatever the data size.  ``skip``
    is the number of leading bytes that all text keys share.
    """

    by: list[str]
    order: str
    table: DataFrame | None = None
    bounds: list = field(default_factory=list)
    skip: int = 0

    def cold(self, df: DataFrame) -> DataFrame | None:
        if not self.by:
            return None
        return matched(df, self.table.select(*self.by), self.by, "left_anti", broadcast=True)

    def hot(self, df: DataFrame) -> DataFrame:
        if not self.by:
            return with_slices(df, {self.order: self.bounds}, {self.order: "_slice"}, self.skip)
        tagged = matched(df, self.table, self.by, broadcast=True)
        sliced = tagged.withColumn("_slice", _slice_of(numeric_key(df, self.order, self.skip), F.col("_bounds"), F.col("_coarse"), F.col("_stride")))
        return sliced.drop("_bounds", "_coarse", "_stride")


def numeric_key(df: DataFrame, name: str, skip: int = 0) -> Column:
    """A number that never falls when the column rises; what groups are cut by. NULL for NULL.

    Text counts by the six bytes after the first ``skip``, which all its values share.
    """
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.DateType):
        return F.unix_date(name).cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(dtype, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(name, "utf-8"), 1 + skip, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(name).cast("double")


def shared_prefix(df: DataFrame, name: str) -> int:
    """Number of leading bytes that all values of a text column share; 0 for other columns."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return 0
    low, high = df.agg(F.encode(F.min(name), "utf-8"), F.encode(F.max(name), "utf-8")).first()
    return len(os.path.commonprefix([bytes(low or b""), bytes(high or b"")]))


def with_slices(df: DataFrame, bounds: dict[str, list[float]], names: dict[str, str], skip: int = 0) -> DataFrame:
    """Number of cut points each column has reached, by a binary search per row in the JVM.

    As Spark sorts, NULL comes before everything (slice -1) and NaN after (a last slice of its own).
    """
    columns = list(bounds)
    keyed = df.withColumns({f"{names[c]}_k": numeric_key(df, c, skip) for c in columns})
    search = Bucketizer(
        splitsArray=[[-math.inf, *sorted(set(bounds[c])), math.inf] for c in columns],
        inputCols=[f"{names[c]}_k" for c in columns], outputCols=[names[c] for c in columns], handleInvalid="keep")
    out = search.transform(keyed)
    return out.withColumns({n: F.coalesce(F.col(n).cast("int"), F.lit(-1)) for n in names.values()}).drop(*[f"{n}_k" for n in names.values()])


def _slice_of(x: Column, bounds: Column, coarse: Column, stride: Column) -> Column:
    """Number of bounds of a hot group that x has reached: first by whole strides, then inside one."""
    whole = F.size(F.filter(coarse, lambda b: b <= x)) * stride
    rest = F.size(F.filter(F.slice(bounds, whole + 1, stride), lambda b: b <= x))
    return F.coalesce((whole + rest).cast("int"), F.lit(0))


def find_cut(df: DataFrame, by: list[str], order: str, probe: DataFrame | None = None, total: int | None = None) -> Cut | None:
    """Groups above the threshold with their cut points, or None if a plain window is fine.

    ``probe`` may be a cheaper table with the same or larger groups, e.g. the base rows of an
    aggregate; if it also has the order column, the cut points come from it as well.  ``total`` is
    its number of rows, if known.
    """
    sized = probe if probe is not None else df
    spark = df.sparkSession
    settings = split_settings(spark)
    total = sized.count() if total is None else total
    if total <= settings.min_rows:
        return None
    limit = settings.threshold(total)
    source = sized if order in sized.columns else df
    skip = shared_prefix(source, order)
    base = source.select(*by, numeric_key(source, order, skip).alias("_key"))
    base = base.where(~F.isnan("_key") & F.col("_key").isNotNull())
    if not by:
        pieces = 2 * math.ceil(total / limit)  # at most some 8 x partitions, see SplitSettings.threshold
        bounds = base.agg(_quantile_grid("_key", pieces).alias("b")).collect()[0]["b"]
        return Cut([], order, bounds=sorted(set(bounds)), skip=skip) if bounds else None
    sizes = sized.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    groups = sizes.collect()  # at most 4 x partitions rows, see SplitSettings.threshold
    if not groups:
        return None
    keys = spark.createDataFrame(groups, sizes.schema)
    grid = 1024
    every = F.greatest(F.lit(1), F.floor(F.lit(float(grid)) * limit / (2 * F.col("_n")))).cast("int")
    cuts = (
        matched(base, keys, by, broadcast=True)
        .groupBy(*by, "_n")
        .agg(_quantile_grid("_key", grid).alias("_bounds"))
        .withColumn("_bounds", F.array_sort(F.array_distinct(F.filter("_bounds", lambda b, i: (i + 1) % every == 0))))
        .withColumn("_stride", F.greatest(F.sqrt(F.size("_bounds")).cast("int"), F.lit(1)))
        .withColumn("_coarse", F.filter("_bounds", lambda b, i: (i + 1) % F.col("_stride") == 0))
        .select(*by, "_bounds", "_coarse", "_stride")
    )
    return Cut(list(by), order, table=spark.createDataFrame(cuts.collect(), cuts.schema), skip=skip)


def _quantile_grid(order: str, pieces: int) -> Column:
    probs = [i / pieces for i in range(1, pieces)] or [0.5]
    return F.percentile_approx(order, probs, max(10000, 10 * pieces))


# ----------------------------------------------------------------------------------------------
# The operator
# ----------------------------------------------------------------------------------------------
def causal(
    df: DataFrame,
    by: list[str],
    order: list[str],
    features: dict[str, Feature],
    probe: DataFrame | None = None,
    bounded: bool = False,
    total: int | None = None,
) -> DataFrame:
    """Add ordered features per group.

    ``order`` must be unique within a group: its first column is the one groups are cut along,
    the rest break ties.  ``bounded`` says that no group can be large whatever the data size, e.g.
    because it has one row per calendar day; the size check is then left out.  ``total`` is the
    number of rows, or a bound on it, if known.
    """
    by, order = list(by), list(order)
    if not bounded and total is None:
        total = (probe if probe is not None else df).count()
    cut = None if bounded else find_cut(df, by, order[0], probe, total)
    folded = {n: f for n, f in features.items() if _depends_on_order(df, f)}
    # A group that may hold more rows than a block has its doubles added block by block, wherever it is computed.
    largest = 0 if bounded else total if cut is None else min(total, split_settings(df.sparkSession).threshold(total))
    blocks = bool(folded) and largest > BLOCK
    if cut is None:
        return _one_window(df, by, order, features, folded if blocks else {})

    plain = df.select(*[_plain(f, Window.partitionBy(*by).orderBy(*order)).alias(n) for n, f in features.items()]).schema
    medians = {n: f for n, f in features.items() if _is_median(f)}
    rest = {n: f for n, f in features.items() if n not in folded and n not in medians}
    done = _sliced(cut.hot(df), by, order, rest).select(*df.columns, *rest, "_pos", "_slice")
    if folded:
        done = _in_blocks(done, by, order, folded)
    if medians:
        done = _sliced_medians(done, by, order, medians)
    done = done.select(*df.columns, *[F.col(n).cast(plain[n].dataType).alias(n) for n in features])  # one type at any size
    cold = cut.cold(df)
    if cold is None:
        return done
    return _one_window(cold, by, order, features, folded if blocks else {}).unionByName(done)


def _one_window(df: DataFrame, by: list[str], order: list[str], features: dict[str, Feature], folded: dict[str, Feature]) -> DataFrame:
    """Every group in one window, but for the features in ``folded``."""
    window = Window.partitionBy(*by).orderBy(*order)
    medians = {n: f for n, f in features.items() if _is_median(f)}
    rest = {n: f for n, f in features.items() if n not in folded and n not in medians} | ({"_pos": prior_count()} if folded else {})
    out = df.select("*", *[_plain(f, window).alias(n) for n, f in rest.items()])
    if folded:
        out = _in_blocks(out, by, order, folded)
    return (_medians(out, by, order, medians) if medians else out).select(*df.columns, *features)


def _depends_on_order(df: DataFrame, feature: Feature) -> bool:
    """Whether the order in which values are added can change the last bits of a cumulative statistic."""
    if feature.kind not in ("expanding", "running"):
        return False
    return feature.stat == "std" or (feature.stat in ("sum", "mean") and isinstance(df.schema[feature.column].dataType, T.FractionalType) and not isinstance(df.schema[feature.column].dataType, T.DecimalType))


def _in_blocks(df: DataFrame, by: list[str], order: list[str], features: dict[str, Feature]) -> DataFrame:
    """Cumulative sums, means and deviations with one order of addition, whatever the cut points.

    ``_pos`` numbers the rows of a group. A block is ``BLOCK`` rows by number, added one after the other in one window; the
    sums of whole blocks are added in order, one row per block. Both depend on the earlier rows of the group alone, so a
    table whose later rows differ gives equal bits. Below one block the result is that of a plain window.
    """
    df = df.withColumn("_block", F.floor(F.col("_pos") / BLOCK).cast("bigint"))
    own = Window.partitionBy(*by, "_block").orderBy(*order)
    columns = sorted({f.column for f in features.values()})
    upto, whole, fold = own.rowsBetween(FIRST, 0), [], []
    across = Window.partitionBy(*by).orderBy("_block").rowsBetween(FIRST, 0)
    for c in columns:
        n, s = F.count(c).over(upto), F.coalesce(F.sum(F.col(c).cast("double")).over(upto), F.lit(0.0))
        q = F.coalesce(F.var_pop(c).over(upto), F.lit(0.0)) * n + F.when(n > 0, s * s / n).otherwise(0.0)
        whole += [n.alias(f"_n_{c}"), s.alias(f"_s_{c}"), q.alias(f"_q_{c}")]
        fold += [F.sum(f"_{k}_{c}").over(across).alias(f"_{k}_{c}") for k in "nsq"]
    ended = df.select(*by, "_block", "_pos", *whole).where(F.col("_pos") % BLOCK == BLOCK - 1)
    earlier = ended.select(*by, (F.col("_block") + 1).alias("_block"), F.lit(True).alias("_later"), *fold)
    both = matched(df, earlier, [*by, "_block"], "left")
    both = both.withColumns({f"_{k}_{c}": F.coalesce(f"_{k}_{c}", F.lit(0)) for k in "nsq" for c in columns})
    both = both.withColumns({f"_t_{c}": F.when(F.col(f"_n_{c}") > 0, F.col(f"_s_{c}")) for c in columns})
    computed = [F.when(F.col("_later"), _with_prefix(both, f, F.lit(True), own)).otherwise(_plain(f, own)).alias(n) for n, f in features.items()]
    return both.select("*", *computed)


def _is_median(feature: Feature) -> bool:
    return feature.kind in ("expanding", "running") and feature.stat == "median"


def _medians(df: DataFrame, by: list[str], order: list[str], features: dict[str, Feature], earlier: DataFrame | None = None) -> DataFrame:
    """Medians of all rows up to each row, in one pass over the ordered rows of every group.

    ``earlier`` holds what a group needs to know of rows that are not in it; see ``_middle_of_earlier``.
    """
    columns = sorted({f.column for f in features.values()})
    rows = df.withColumns({f"_v{i}": F.col(c).cast("double") for i, c in enumerate(columns)}).withColumn("_own", F.lit(True))
    if earlier is not None:
        rows = rows.unionByName(earlier.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("_own", *order)))
    added = [T.StructField(n, T.DoubleType()) for n in features]
    wanted = [(n, columns.index(f.column), f.kind == "running", f.min_periods) for n, f in features.items()]
    kept, names, width, sliced = list(df.columns), list(features), len(columns), earlier is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middles = [Middle() for _ in range(width)]
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            own = get("_own").to_numpy(zero_copy_only=False)
            first = (get("_at").to_numpy(zero_copy_only=False) == 1).tolist()
            found = []
            for i, middle in enumerate(middles):
                base = [None] * len(own)
                if sliced:
                    base = list(zip(*[get(c).to_pylist() for c in ("_which", "_count", "_prior", "_least", "_most", "_skip")]))
                    base = [None if mine else b for mine, b in zip(own.tolist(), base)]
                found.append(middle.follow(ordered_keys(get(f"_v{i}")), first, base, i))
            computed = []
            for _, i, after, least in wanted:
                value, n = found[i][after]
                computed.append(pa.array(value[own], pa.float64(), mask=(n < max(least, 1))[own]))
            rest = batch.select(kept).filter(pa.array(own)) if sliced else batch.select(kept)
            yield pa.RecordBatch.from_arrays([*rest.columns, *computed], names=[*kept, *names])

    return rows.sortWithinPartitions(*by, "_at").mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def ordered_keys(values: pa.Array) -> list[int | None]:
    """Integers in the order of the doubles, NaN last; None for a null."""
    keys = _flipped(np.where(np.isnan(x := values.to_numpy(zero_copy_only=False)), np.nan, x + 0.0).view(np.int64)).astype(object)
    keys[~values.is_valid().to_numpy(zero_copy_only=False)] = None
    return keys.tolist()


def _flipped(bits: np.ndarray) -> np.ndarray:
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


class Middle:
    """The two values in the middle of a growing multiset: a heap of its lower half and one of its upper half.

    Values so far out that they cannot get to the middle may be left out and count as ``below`` or ``above`` only.
    """

    def __init__(self):
        self.start()

    def start(self, values: list[int] | None = None, prior: int = 0, below: int = 0):
        """``values``, sorted, are the ``prior`` earlier ones without ``below`` smallest and some of the largest."""
        at = (prior + 1) // 2 - below
        self.low, self.high = [-x for x in reversed((values or [])[:at])], (values or [])[at:]
        self.n_low, self.n_high, self.waiting = (prior + 1) // 2, prior // 2, []

    def take_waiting(self):
        (_, _, prior, least, most, skip), now, values = self.waiting[0][1], self.waiting[0][1][5], []
        for key, (_, count, *_) in sorted(self.waiting):
            values += [key] * max(min(now + count, most + 1) - max(now, least), 0)
            now += count
        self.start(values, prior, least)

    def follow(self, keys: list, first: list[bool], base: list, which: int) -> dict[bool, tuple[np.ndarray, np.ndarray]]:
        """Median and number of values before (False) and after (True) each row; ``first`` starts a group.

        A row with a ``base`` is an earlier value with its count, if it is one of this column.
        """
        size = len(keys)
        lows, highs, counts = ([0] * size, [0] * size), ([0] * size, [0] * size), ([0] * size, [0] * size)
        for k, (x, new, earlier) in enumerate(zip(keys, first, base)):
            if new:
                self.start()
            if earlier is not None:
                if earlier[0] == which:
                    self.waiting.append((x, earlier))
                continue
            if self.waiting:
                self.take_waiting()
            for after in (0, 1):
                if after and x is not None:
                    self.add(x)
                if n := self.n_low + self.n_high:
                    lows[after][k] = -self.low[0]
                    highs[after][k] = -self.low[0] if self.n_low > self.n_high else self.high[0]
                    counts[after][k] = n
        out = {}
        for after in (0, 1):
            low, high = (_flipped(np.array(x[after], np.int64)).view(np.float64) for x in (lows, highs))
            with np.errstate(all="ignore"):
                out[bool(after)] = np.where(low == high, low, low * 0.5 + high * 0.5), np.array(counts[after], np.int64)
        return out

    def add(self, x: int):
        if self.n_low and x <= -self.low[0]:
            heappush(self.low, -x)
            self.n_low += 1
            if self.n_low > self.n_high + 1:
                heappush(self.high, -heappop(self.low))
                self.n_low, self.n_high = self.n_low - 1, self.n_high + 1
        else:
            heappush(self.high, x)
            self.n_high += 1
            if self.n_high > self.n_low:
                heappush(self.low, -heappop(self.high))
                self.n_low, self.n_high = self.n_low + 1, self.n_high - 1


#: Cells into which the values of a cut group are dealt to find the middle of its earlier slices.
CELLS = 1024


def _middle_of_earlier(hot: DataFrame, by: list[str], column: str, which: int) -> DataFrame:
    """Per slice: the values of earlier slices that can become the median of a row in it, with their counts.

    A slice of m values moves the median by m / 2 places at most, so it needs about m of the earlier values, however many there
    are. Counts by slice and cell tell in which cells they lie. One row per slice and value: ``_v<which>``, ``_count``, the
    number of earlier values (``_prior``), the places asked for (``_least`` to ``_most``) and the place of the first value (``_skip``).
    """
    spread = lambda a, b, broadcast=False: matched(a, b, by, broadcast=broadcast) if by else a.crossJoin(F.broadcast(b) if broadcast else b)
    values = hot.select(*by, "_slice", F.col(column).cast("double").alias("_v")).where("_v IS NOT NULL")
    grid = values.where(~F.isnan("_v")).groupBy(*by).agg(_quantile_grid("_v", CELLS).alias("_bounds"))
    grid = grid.withColumn("_bounds", F.coalesce(F.array_distinct("_bounds"), F.array().cast("array<double>")))
    grid = grid.withColumn("_stride", F.greatest(F.sqrt(F.size("_bounds")).cast("int"), F.lit(1)))
    grid = materialise(grid.withColumn("_coarse", F.filter("_bounds", lambda b, i: (i + 1) % F.col("_stride") == 0)), "median-grid")
    counted = values.groupBy(*by, "_slice", "_v").agg(F.count(F.lit(1)).alias("_c"))
    joined = matched(counted, grid, by, "left", broadcast=True) if by else counted.crossJoin(F.broadcast(grid))
    cell = F.coalesce(_slice_of(F.col("_v"), F.col("_bounds"), F.col("_coarse"), F.col("_stride")), F.lit(0))
    celled = materialise(joined.select(*by, "_slice", "_v", "_c", cell.alias("_cell")), "median-cells")

    through = Window.partitionBy(*by).orderBy("_slice").rowsBetween(FIRST, -1)
    slices = hot.groupBy(*by, "_slice").agg(F.count(column).alias("_m")).withColumn("_prior", F.coalesce(F.sum("_m").over(through), F.lit(0)))
    reach = F.ceil(F.col("_m") / 2) + 1
    slices = slices.withColumns({
        "_least": F.greatest(F.floor((F.col("_prior") - 1) / 2) - reach, F.lit(0)), "_most": F.least(F.floor(F.col("_prior") / 2) + reach, F.col("_prior") - 1)})
    sums = celled.groupBy(*by, "_slice", "_cell").agg(F.sum("_c").alias("_c"))
    dense = matched(spread(slices, sums.select(*by, "_cell").distinct()), sums, [*by, "_slice", "_cell"], "left")
    dense = dense.withColumn("_n", F.coalesce(F.sum("_c").over(Window.partitionBy(*by, "_cell").orderBy("_slice").rowsBetween(FIRST, -1)), F.lit(0)))
    dense = dense.withColumn("_below", F.sum("_n").over(Window.partitionBy(*by, "_slice").orderBy("_cell").rowsBetween(FIRST, 0)) - F.col("_n"))
    asked = dense.where((F.col("_n") > 0) & (F.col("_below") + F.col("_n") > F.col("_least")) & (F.col("_below") <= F.col("_most")))
    asked = asked.withColumn("_skip", F.min("_below").over(Window.partitionBy(*by, "_slice")))
    asked = materialise(asked.select(*by, "_cell", F.col("_slice").alias("_for"), "_prior", "_least", "_most", "_skip"), "median-asked")
    met = matched(celled, asked, [*by, "_cell"]).where("_slice < _for")
    met = met.groupBy(*by, "_for", "_prior", "_least", "_most", "_skip", "_v").agg(F.sum("_c").alias("_count"))
    return met.withColumnsRenamed({"_for": "_slice", "_v": f"_v{which}"}).withColumn("_which", F.lit(which))


def _sliced_medians(hot: DataFrame, by: list[str], order: list[str], features: dict[str, Feature]) -> DataFrame:
    """The same for groups that are cut: a slice is a group that knows the middle of the earlier ones."""
    hot = materialise(hot, "medians")
    parts = [_middle_of_earlier(hot, by, c, i) for i, c in enumerate(sorted({f.column for f in features.values()}))]
    earlier = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return _medians(hot, [*by, "_slice"], order, features, earlier)


def _sliced(hot: DataFrame, by: list[str], order: list[str], features: dict[str, Feature]) -> DataFrame:
    back = max([f.size for f in features.values() if f.kind in ("lag", "rolling")], default=0)
    ahead = max([f.size for f in features.values() if f.kind == "lead"], default=0)
    cumulative = sorted({f.column for f in features.values() if f.kind in ("expanding", "running")})
    earlier = _earlier_slices(hot, by, cumulative, back, ahead)
    hot = matched(hot, earlier, [*by, "_slice"], broadcast=True)  # one row per slice

    own = Window.partitionBy(*by, "_slice").orderBy(*order)
    hot = hot.withColumn("_pos", F.col("_start") + F.row_number().over(own) - 1)
    if back or ahead:
        hot = _with_halo(hot, by, back, ahead)
        own = Window.partitionBy(*by, "_target").orderBy(*order)
    else:
        hot = hot.withColumn("_target", F.col("_slice"))

    mine = F.col("_target") == F.col("_slice")
    computed = []
    for name, feature in features.items():
        if feature.kind == "position":
            value = F.col("_pos").cast("bigint")
        elif feature.kind in ("expanding", "running"):
            value = _with_prefix(hot, feature, mine, own)
        else:
            value = _plain(feature, own)
        computed.append(value.alias(name))
    return hot.select("*", *computed).filter(mine)


def _earlier_slices(hot: DataFrame, by: list[str], columns: list[str], back: int, ahead: int) -> DataFrame:
    """Per slice: rows before it and the moments and extremes of ``columns`` in them."""
    sums = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        n, s = F.count(c), F.sum(F.col(c).cast("double"))
        sums += [
            n.alias(f"_n_{c}"), s.alias(f"_s_{c}"), _exact_sum(hot, c).alias(f"_t_{c}"), F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"),
            (F.coalesce(F.var_pop(c), F.lit(0.0)) * n + F.coalesce(s * s / n, F.lit(0.0))).alias(f"_q_{c}"),
        ]
    by_slice = Window.partitionBy(*by).orderBy("_slice")
    before = by_slice.rowsBetween(FIRST, -1)
    kept = [F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")]
    for c in columns:
        kept += [
            F.coalesce(F.sum(f"_n_{c}").over(before), F.lit(0)).alias(f"_n_{c}"),
            F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0.0)).alias(f"_s_{c}"),
            F.sum(f"_t_{c}").over(before).alias(f"_t_{c}"),
            F.coalesce(F.sum(f"_q_{c}").over(before), F.lit(0.0)).alias(f"_q_{c}"),
            F.min(f"_lo_{c}").over(before).alias(f"_lo_{c}"),
            F.max(f"_hi_{c}").over(before).alias(f"_hi_{c}"),
        ]
    per_slice = hot.groupBy(*by, "_slice").agg(*sums).select(*by, "_slice", "_rows", *kept)
    if not (back or ahead):
        return per_slice
    # A slice has at least one row, so a halo of n rows reaches no further than n slices.
    spot = F.struct(F.col("_slice").alias("slice"), F.col("_start").alias("start"), (F.col("_start") + F.col("_rows")).alias("stop"))
    return per_slice.withColumn("_near", F.collect_list(spot).over(by_slice.rowsBetween(-ahead, back)))


def _exact_sum(df: DataFrame, c: str) -> Column:
    """Sum of a column, of integers and decimals without a detour over doubles."""
    exact = isinstance(df.schema[c].dataType, (T.IntegralType, T.DecimalType))
    return F.sum(c if exact else F.col(c).cast("double"))


def _with_halo(hot: DataFrame, by: list[str], back: int, ahead: int) -> DataFrame:
    """Copy a row to every slice that has to look back or ahead to it."""
    pos = F.col("_pos")
    stop = F.col("_start") + F.col("_rows")
    near_edge = (pos + back >= stop) | (pos - ahead < F.col("_start"))
    needed = F.filter(
        "_near",
        lambda s: ((s["start"] > pos) & (s["start"] <= pos + back)) | ((s["stop"] <= pos) & (s["stop"] + ahead > pos)),
    )
    targets = F.when(near_edge, F.concat(F.array("_slice"), F.transform(needed, lambda s: s["slice"]))).otherwise(F.array("_slice"))
    return hot.withColumn("_target", F.explode(targets)).drop("_near")


def _with_prefix(hot: DataFrame, feature: Feature, mine: Column, window) -> Column:
    """Statistic over the rows of earlier slices joined with the earlier rows of this slice."""
    c = feature.column
    value = F.when(mine, F.col(c))
    over = window.rowsBetween(FIRST, -1 if feature.kind == "expanding" else 0)
    n1, s1, q1 = F.col(f"_n_{c}"), F.col(f"_s_{c}"), F.col(f"_q_{c}")
    n2 = F.count(value).over(over)
    s2 = F.coalesce(F.sum(value.cast("double")).over(over), F.lit(0.0))
    n = n1 + n2
    if feature.stat == "count":
        out = n
    elif feature.stat == "sum":
        exact = isinstance(hot.schema[c].dataType, (T.IntegralType, T.DecimalType))
        t1, t2 = F.col(f"_t_{c}"), F.sum(value if exact else value.cast("double")).over(over)
        out = F.when(t1.isNull(), t2).when(t2.isNull(), t1).otherwise(t1 + t2)
    elif feature.stat == "mean":
        out = F.when(n > 0, (s1 + s2) / n)
        kind = hot.schema[c].dataType
        if isinstance(kind, T.DecimalType):
            t1, t2 = F.col(f"_t_{c}"), F.sum(value).over(over)
            total = F.when(t1.isNull(), t2).when(t2.isNull(), t1).otherwise(t1 + t2)
            # As wide as a plain sum, so that the division keeps more digits than the mean has.
            out = F.when(n > 0, total.cast(T.DecimalType(min(kind.precision + 10, 38), kind.scale)) / n)
    elif feature.stat == "min":
        out = F.least(F.col(f"_lo_{c}"), F.min(value).over(over))
    elif feature.stat == "max":
        out = F.greatest(F.col(f"_hi_{c}"), F.max(value).over(over))
    else:
        m2a = F.when(n1 > 0, q1 - s1 * s1 / n1).otherwise(0.0)
        m2b = F.coalesce(F.var_pop(value).over(over), F.lit(0.0)) * n2
        gap = F.when((n1 > 0) & (n2 > 0), s1 / n1 - s2 / n2).otherwise(0.0)
        m2 = m2a + m2b + F.when(n > 0, gap * gap * n1 * n2 / n).otherwise(0.0)
        out = F.when(n > 1, F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1)))
    return F.when(n >= feature.min_periods, out) if feature.min_periods > 1 else out


# ----------------------------------------------------------------------------------------------
# Ranks, prefix sums over values, order statistics
# ----------------------------------------------------------------------------------------------
def cumulate(
    hist: DataFrame, by: list[str], value: str, sums: dict[str, str], descending: bool = False,
    probe: DataFrame | None = None, bounded: bool = False, total: int | None = None,
) -> DataFrame:
    """Exclusive prefix sums over distinct values: ``sums`` maps a new column to the summed one.

    ``hist`` holds one row per (group, value).
    """
    key = value
    if descending:
        key = "_minus"
        hist = hist.withColumn(key, -F.col(value))
        probe = probe.withColumn(key, -F.col(value)) if probe is not None else None
    out = causal(hist, by, [key], {n: expanding(c, "sum") for n, c in sums.items()}, probe, bounded, total)
    out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in sums})
    return out.drop("_minus") if descending else out


def average_ranks(
    df: DataFrame, by: list[str], values: dict[str, str], pct: bool = True, probe: DataFrame | None = None, bounded: bool = False,
) -> DataFrame:
    """Ranks within the group, ties averaged, NULL for NULL; ``values`` maps a new column to the ranked one.

    With ``pct`` a rank is divided by the number of non-null values.  ``probe`` is a cheaper table
    with the same groups for the size check.
    """
    by, out, added = list(by), df, {}
    for name, value in values.items():
        cut = find_cut(df, by, value, probe) if not added and not bounded else None
        if cut is not None:
            out = _ranked_by_value(out, df, by, value, name, pct, probe)
            continue
        ranked = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
        ties = Window.partitionBy(*by, value)
        rank = F.rank().over(ranked) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
        if pct:
            rank = rank / F.count(value).over(Window.partitionBy(*by))
        added[name] = F.when(F.col(value).isNotNull(), rank)
    return out.withColumns(added) if added else out


def _ranked_by_value(out, df, by, value, name, pct, probe) -> DataFrame:
    """Ranks from the counts of distinct values, joined back to the rows."""
    hist = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = cumulate(hist, by, value, {"_before": "_c"}, probe=df)
    ranks = ranks.withColumn("_rank", F.col("_before") + (F.col("_c") + 1) / F.lit(2.0))
    if pct:
        sizes = hist.groupBy(*by).agg(F.sum("_c").alias("_size"))
        ranks = matched(ranks, sizes, by) if by else with_scalars(ranks, sizes)
        ranks = ranks.withColumn("_rank", F.col("_rank") / F.col("_size"))
    columns = out.columns
    return matched(out, ranks.select(*by, value, F.col("_rank").alias(name)), [*by, value], "left").select(*columns, name)


def average_rank(df: DataFrame, by: list[str], value: str, name: str, pct: bool = True, probe: DataFrame | None = None) -> DataFrame:
    return average_ranks(df, by, {name: value}, pct, probe)


def one_row_per_day(df: DataFrame, order: str) -> bool:
    """Whether the order column is a calendar date, of which there are few however many rows."""
    return isinstance(df.schema[order].dataType, T.DateType)


def row_position(df: DataFrame, order: list[str], name: str, descending: bool = False) -> DataFrame:
    """0-based position of every row of the table under ``order``, which must be unique.

    ``descending`` applies to the first order column.  If one value of that column repeats on more
    rows than a task should sort, positions are built from the counts of the values and the
    position among equal values.
    """
    first = order[0]
    if order == [first] and one_row_per_day(df, first):
        return causal(df.withColumn("_minus", F.datediff(F.lit("1970-01-01"), first)) if descending else df, [], ["_minus"] if descending else order,
                      {name: prior_count()}, bounded=True).drop("_minus")
    total = df.count()
    small = total <= split_settings(df.sparkSession).min_rows
    if len(order) > 1 and find_cut(df, [first], order[1], total=total) is not None:
        counts = df.groupBy(first).agg(F.count(F.lit(1)).alias("_c"))
        offsets = cumulate(counts, [], first, {"_before": "_c"}, descending, probe=df).select(F.col(first).alias("_v"), "_before")
        among = causal(df, [first], order[1:], {"_among": prior_count()})
        joined = among.join(offsets, F.col(first).eqNullSafe(F.col("_v")))
        return joined.withColumn(name, (F.col("_before") + F.col("_among")).cast("bigint")).select(*df.columns, name)
    if not descending:
        return causal(df, [], order, {name: prior_count()}, bounded=small)
    out = df.withColumn("_minus", -F.col(first))
    return causal(out, [], ["_minus", *order[1:]], {name: prior_count()}, bounded=small).drop("_minus")


def chunk_of(position: Column, total: Column, chunks: int) -> Column:
    """1-based chunk of a 0-based position when the first ``total mod chunks`` chunks get one row more."""
    size, extra = F.floor(total / chunks), total % chunks
    in_large = F.floor(position / (size + 1))
    in_small = F.floor((position - extra * (size + 1)) / F.greatest(size, F.lit(1))) + extra
    return (F.when(position < extra * (size + 1), in_large).otherwise(in_small) + 1).cast("int")


def quantiles(df: DataFrame, value, probs: list[float], total: int | None = None) -> list[float]:
    """Exact quantiles of one column with linear interpolation, as numbers; see ``column_quantiles``."""
    return column_quantiles(df.select(col(value).alias("_v")), ["_v"], probs, total)["_v"]


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float], total: int | None = None) -> dict[str, list[float]]:
    """Exact quantiles of several columns with linear interpolation, as numbers.

    A small table is aggregated directly.  A large one takes three passes for all columns together:
    a sketch gives cut points, one counting pass tells which slices hold the wanted positions, and
    only the values of those slices are shuffled and ordered.  ``total`` is the number of rows, or a
    bound on it, if known.
    """
    spark = df.sparkSession
    settings = split_settings(spark)
    base = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    total = base.count() if total is None else total
    if total <= settings.min_rows:
        row = base.agg(*[F.percentile(c, F.lit([float(p) for p in probs])).alias(c) for c in columns]).collect()[0]
        return {c: list(row[c] or []) for c in columns}
    pieces = 2 * math.ceil(total / settings.threshold(total))  # at most some 8 x partitions
    grids = base.agg(*[_quantile_grid(c, pieces).alias(c) for c in columns]).collect()[0]
    slices = {c: f"_s{i}" for i, c in enumerate(columns)}
    sliced = with_slices(base, {c: list(grids[c] or []) for c in columns}, slices)
    cells = [F.struct(F.lit(i).alias("c"), F.col(slices[c]).alias("s"), F.col(c).alias("v")) for i, c in enumerate(columns)]
    long = sliced.select(F.explode(F.array(*cells)).alias("e")).select("e.*").filter("v IS NOT NULL")
    counts = sorted((r["c"], r["s"], r["n"]) for r in long.groupBy("c", "s").agg(F.count(F.lit(1)).alias("n")).collect())
    size = {i: sum(n for c, _, n in counts if c == i) for i in range(len(columns))}
    wanted = {i: sorted({f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)}) if n else [] for i, n in size.items()}
    starts, at = [], dict.fromkeys(size, 0)
    for c, s, n in counts:
        here = [w for w in wanted[c] if at[c] <= w < at[c] + n]
        if here:
            starts.append((c, s, at[c], here))
        at[c] += n
    if not starts:
        return {c: [] for c in columns}
    needed = spark.createDataFrame(starts, "c int, s int, start bigint, wanted array<bigint>")  # at most two slices per probability
    hist = long.join(F.broadcast(needed), ["c", "s"]).groupBy("c", "s", "v", "start", "wanted").agg(F.count(F.lit(1)).alias("n"))
    through = F.sum("n").over(Window.partitionBy("c", "s").orderBy("v").rowsBetween(FIRST, 0)) + F.col("start")
    placed = hist.withColumn("to", through).filter(F.exists("wanted", lambda w: (w < F.col("to")) & (w >= F.col("to") - F.col("n"))))
    found = {}
    for r in placed.collect():  # at most two rows per probability and column
        found.update({(r["c"], w): r["v"] for w in r["wanted"] if r["to"] - r["n"] <= w < r["to"]})
    out = {}
    for i, name in enumerate(columns):
        out[name] = []
        for p in probs if size[i] else []:
            spot = p * (size[i] - 1)
            low, high = found[i, math.floor(spot)], found[i, math.ceil(spot)]
            out[name].append(low + (high - low) * (spot - math.floor(spot)))
    return out


def group_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per group with linear interpolation; one column per entry of ``probs``."""
    by = list(by)
    base = df.select(*by, F.col(value).cast("double").alias("_v"))
    if find_cut(base, by, "_v") is None:
        return base.groupBy(*by).agg(*[F.percentile("_v", float(p)).alias(n) for n, p in probs.items()])
    hist = base.filter("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    sizes = hist.groupBy(*by).agg(F.sum("_c").alias("_size"))
    placed = cumulate(hist, by, "_v", {"_before": "_c"}, probe=base)
    placed = matched(placed, sizes, by) if by else with_scalars(placed, sizes)
    at = {n: F.lit(float(p)) * (F.col("_size") - 1) for n, p in probs.items()}
    holds = lambda w: F.when((w >= F.col("_before")) & (w < F.col("_before") + F.col("_c")), F.col("_v"))
    picked = placed.groupBy(*by, "_size").agg(
        *[F.max(holds(F.floor(w))).alias(f"_lo_{n}") for n, w in at.items()],
        *[F.max(holds(F.ceil(w))).alias(f"_hi_{n}") for n, w in at.items()],
    )
    return picked.select(
        *by,
        *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (w - F.floor(w))).alias(n) for n, w in at.items()],
    )
