"""Evaluation of scores against outcomes.

The ranking metrics share one shape: rows are first reduced to counts per distinct score, the
counts are turned into prefix sums (cut into slices when large), and everything else is an
aggregate over them.  ``by`` gives one row of metrics per group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.bands import bin_left_closed, count_edges
from ..functions.normal import erfc
from ..functions.scalar import matched, safe_corr, safe_div, uniform, with_scalars
from ..session import materialise, split_settings
from ..sources import specs
from .ordered import average_ranks, causal, cumulate, group_quantiles, prior_count, quantiles

EPS = 1e-15
CURVE_STEP = 1.0 / (specs.THRESHOLD_POINTS - 1)


def pairs(df: DataFrame, label: str, score: str, *keep: str) -> DataFrame:
    """Rows with both a label and a score, as doubles."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return df.select(*keep, number(label).alias("label"), number(score).alias("score")).filter("label IS NOT NULL AND score IS NOT NULL")


def score_counts(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score."""
    w = F.col(weight) if weight else F.lit(1)
    positive = F.col("label") > 0.5
    return df.groupBy(*by, "score").agg(
        F.sum(F.when(positive, w).otherwise(0)).alias("pos"), F.sum(F.when(positive, 0).otherwise(w)).alias("neg"))


def ranking_metrics(
    df: DataFrame, label: str, score: str, by: list[str] | None = None, weight: str | None = None, bounded: bool = False, total: int | None = None,
) -> DataFrame:
    """ROC-AUC with averaged ties, average precision and KS per block of tied scores; NULL if a class is absent.

    ``bounded`` and ``total`` spare the size check, as in ``ordered.causal``.
    """
    by = list(by or [])
    rows = pairs(df, label, score, *by, *([weight] if weight else []))
    return ranked_counts(score_counts(rows, by, weight), by, rows, bounded, total)


def ranked_counts(counts: DataFrame, by: list[str], probe: DataFrame | None = None, bounded: bool = False, total: int | None = None) -> DataFrame:
    """The same metrics from the positives and negatives per group and distinct score."""
    placed = cumulate(counts, by, "score", {"tp": "pos", "fp": "neg"}, descending=True, probe=probe, bounded=bounded, total=total)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    placed = matched(placed, totals, by) if by else with_scalars(placed, totals)
    pos, neg, tp, fp, p, n = (F.col(x).cast("double") for x in ("pos", "neg", "tp", "fp", "p", "n"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    seen = tp + pos + fp + neg
    return placed.groupBy(*by, "p", "n").agg(
        F.sum(pos * (n - fp - neg + neg / 2)).alias("_u"),
        F.sum(F.when(seen > 0, pos * (tp + pos) / seen)).alias("_ap"),
        F.max(F.abs(safe_div(tp + pos, p) - safe_div(fp + neg, n))).alias("_ks"),
    ).select(
        *by, F.when(both, F.col("_u") / (p * n)).alias("roc_auc"), F.when(F.col("p") > 0, F.col("_ap") / p).alias("pr_auc"),
        F.when(both, F.col("_ks")).alias("ks"))


def probability_metrics(df: DataFrame, label: str, score: str, by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Brier score, log loss and the confusion measures at one threshold, in one aggregate."""
    by = list(by or [])
    y, s = F.col("label"), F.col("score")
    clipped = F.least(F.greatest(s, F.lit(EPS)), F.lit(1 - EPS))
    hit = s >= threshold
    both = lambda a, b: F.count_if(a & b).cast("double")
    agg = pairs(df, label, score, *by).groupBy(*by).agg(
        F.avg((s - y) * (s - y)).alias("brier"), F.avg(-(y * F.ln(clipped) + (1 - y) * F.ln(1 - clipped))).alias("log_loss"),
        both(hit, y == 1).alias("_tp"), both(hit, y == 0).alias("_fp"), both(~hit, y == 1).alias("_fn"), both(~hit, y == 0).alias("_tn"),
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_positive"))
    agg = agg.withColumns({
        "precision": F.col("_tp") / (F.col("_tp") + F.col("_fp") + EPS), "recall": F.col("_tp") / (F.col("_tp") + F.col("_fn") + EPS)})
    return agg.select(
        *by, "brier", "log_loss", safe_div(F.col("_tp") + F.col("_tn"), "n").alias("accuracy"), "precision", "recall",
        (2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS)).alias("f1"),
        (F.col("_tn") / (F.col("_tn") + F.col("_fp") + EPS)).alias("specificity"), safe_div("n_positive", "n").alias("base_rate"),
        "n", "n_positive")


def top_events(df: DataFrame, label: str, score: str, key: str, positions: list[int], total: int | None = None) -> list[float]:
    """Sum of labels among the first p rows by falling score, ties by key, for each p.

    Counts per score decide all blocks of ties that lie on one side of p.  Only a block that p
    cuts through is ordered by key.
    """
    rows = pairs(df, label, score, key)
    counts = rows.groupBy("score").agg(F.count(F.lit(1)).alias("c"), F.sum("label").alias("s"))
    placed = cumulate(counts, [], "score", {"c0": "c", "s0": "s"}, descending=True, probe=rows, total=total)
    wanted = F.lit([int(p) for p in positions])
    cut = placed.withColumn("p", F.explode(F.filter(wanted, lambda w: (w > F.col("c0")) & (w <= F.col("c0") + F.col("c")))))
    found = {r["p"]: r for r in cut.collect()}  # one row per position
    out = {p: r["s0"] + (r["s"] if r["c0"] + r["c"] == p else 0) for p, r in found.items()}
    partial = {p: r for p, r in found.items() if r["c0"] + r["c"] != p}
    if partial:
        blocks = rows.filter(F.col("score").isin(sorted({r["score"] for r in partial.values()})))
        among = causal(blocks, ["score"], [key], {"_at": prior_count()}, total=sum(int(r["c"]) for r in partial.values()))
        sums = among.agg(*[
            F.sum(F.when((F.col("score") == r["score"]) & (F.col("_at") < p - r["c0"]), F.col("label")).otherwise(0.0)).alias(str(p))
            for p, r in partial.items()]).collect()[0]
        for p in partial:
            out[p] += sums[str(p)]
    return [float(out.get(p, 0.0)) for p in positions]


def lift_at(df: DataFrame, label: str, score: str, key: str, shares: list[float]) -> DataFrame:
    """Event rate of the top share of rows against the base rate."""
    if any(not 0 < k <= 1 for k in shares):
        raise ValueError("a share lies in (0, 1]")
    totals = pairs(df, label, score).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("s")).collect()[0]
    tops = [max(1, round(totals["n"] * k)) for k in shares]
    events = top_events(df, label, score, key, tops, totals["n"])
    base = (totals["s"] or 0.0) / totals["n"] if totals["n"] else 0.0
    rows = [(float(k), top, e / top / base if base else None) for k, top, e in zip(shares, tops, events)]
    return df.sparkSession.createDataFrame(rows, "share double, n_top bigint, lift double")


def gains_table(df: DataFrame, label: str, score: str, key: str, n_bins: int = 10) -> DataFrame:
    """Events, capture and lift of equal chunks by falling score."""
    totals = pairs(df, label, score).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("s")).collect()[0]
    n, s = totals["n"], totals["s"] or 0.0
    if n == 0:
        raise ValueError("no row has both a label and a score")
    sizes = [n // n_bins + (1 if i < n % n_bins else 0) for i in range(n_bins)]
    ends = [sum(sizes[: i + 1]) for i in range(n_bins)]
    through = top_events(df, label, score, key, ends, n)
    base, rows = s / n, []
    for i, (size, end, cumulative) in enumerate(zip(sizes, ends, through)):
        events = cumulative - (through[i - 1] if i else 0.0)
        rate = events / size if size else None
        rows.append((
            i + 1, size, int(events), rate, int(cumulative), cumulative / s if s else None,
            rate / base if base and size else None, cumulative / end / base if base and end else None))
    return df.sparkSession.createDataFrame(
        rows, "decile int, n bigint, n_events bigint, event_rate double, cumulative_events bigint, cumulative_capture double, lift double, cumulative_lift double")


def binary_metrics(df: DataFrame, label: str, score: str, key: str, threshold: float = 0.5, shares=(0.05, 0.10, 0.20)) -> DataFrame:
    """Every binary measure as (metric, value) rows."""
    lifts = lift_at(df, label, score, key, list(shares))
    n = pairs(df, label, score).count()
    wide = with_scalars(ranking_metrics(df, label, score, total=n), probability_metrics(df, label, score, threshold=threshold))
    names = wide.columns
    cells = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)
    long = wide.selectExpr(f"stack({len(names)}, {cells}) AS (metric, value)")
    return long.unionByName(lifts.select(
        F.concat(F.lit("lift@"), (F.col("share") * 100).cast("int"), F.lit("pct")).alias("metric"), F.col("lift").alias("value")))


def regression_metrics(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """RMSE, MAE, median absolute error, R2 and bias."""
    by = list(by or [])
    y, e = F.col(truth).cast("double"), F.nanvl(F.col(predicted).cast("double") - F.col(truth), F.lit(None).cast("double"))
    # A row without both values has no error, and aggregates skip it; no filter re-evaluates the prediction.
    rows = df.select(*by, e.alias("e"), y.alias("y")).withColumn("a", F.abs("e"))
    medians = group_quantiles(rows, by, "a", {"medae": 0.5})
    known = F.when(F.col("e").isNotNull(), F.col("y"))
    agg = rows.groupBy(*by).agg(
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("a").alias("mae"), F.sum(F.col("e") * F.col("e")).alias("_sse"),
        (F.var_pop(known) * F.count("e")).alias("_sst"), F.avg("e").alias("bias"), F.count("e").alias("n"))
    joined = matched(agg, medians, by) if by else with_scalars(agg, medians)
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst"))
    return joined.select(*by, "rmse", "mae", "medae", r2.alias("r2"), "bias", "n")


def multiclass_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, per-class precision, recall and F1, their means, as (metric, value) rows."""
    cells = df.groupBy(F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("k"))
    sides = F.explode(F.array(
        F.struct(F.col("t").alias("c"), F.lit("t").alias("side")), F.struct(F.col("p").alias("c"), F.lit("p").alias("side"))))
    per = cells.select(sides.alias("x"), (F.col("t") == F.col("p")).alias("hit"), "k").groupBy(F.col("x.c").alias("c")).agg(
        F.sum(F.when(F.col("hit") & (F.col("x.side") == "t"), F.col("k")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("hit") & (F.col("x.side") == "p"), F.col("k")).otherwise(0)).alias("fp"),
        F.sum(F.when(~F.col("hit") & (F.col("x.side") == "t"), F.col("k")).otherwise(0)).alias("fn"))
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp") + EPS), F.col("tp") / (F.col("tp") + F.col("fn") + EPS)
    per = per.select("c", precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall + EPS)).alias("f1"))
    named = per.selectExpr("stack(3, 'precision_' || c, precision, 'recall_' || c, recall, 'f1_' || c, f1) AS (metric, value)")
    means = per.agg(F.avg("f1").alias("f"), F.avg("recall").alias("r")).selectExpr("stack(2, 'macro_f1', f, 'balanced_accuracy', r) AS (metric, value)")
    overall = cells.agg(
        (F.sum(F.when(F.col("t") == F.col("p"), F.col("k")).otherwise(0)) / F.sum("k")).alias("a"), F.sum("k").cast("double").alias("n"),
    ).selectExpr("stack(2, 'accuracy', a, 'n', n) AS (metric, value)")
    return overall.unionByName(named).unionByName(means)


# ----------------------------------------------------------------------------------------------
# Calibration and drift
# ----------------------------------------------------------------------------------------------
def calibration_table(df: DataFrame, label: str, score: str, n_bins: int = 10, strategy: str = "quantile") -> DataFrame:
    """Mean score against observed rate per bin of the score."""
    rows = pairs(df, label, score)
    if strategy == "quantile":
        edges = sorted(set(quantiles(rows, "score", [i / n_bins for i in range(n_bins + 1)])))
    else:
        low, high = rows.agg(F.min("score"), F.max("score")).collect()[0]
        edges = [low + (high - low) * i / n_bins for i in range(n_bins + 1)] if low is not None and high > low else []
    if len(edges) < 2:
        return df.sparkSession.createDataFrame([], "bin int, n bigint, mean_predicted double, observed_rate double, gap double")
    bins = rows.groupBy(bin_left_closed("score", edges).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_predicted"), F.avg("label").alias("observed_rate"))
    return bins.withColumn("gap", F.col("observed_rate") - F.col("mean_predicted"))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    """Row-weighted mean absolute gap of a calibration table."""
    return table.agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))


def population_stability(reference: DataFrame, current: DataFrame, value: str, n_bins: int = 10) -> DataFrame:
    """Population stability index over quantile bins of the reference; NULL with fewer than three edges."""
    edges = sorted(set(quantiles(reference, value, [i / n_bins for i in range(n_bins + 1)])))
    if len(edges) < 3:
        return reference.sparkSession.createDataFrame([(None,)], "psi double")
    inner = edges[1:-1]
    slot = count_edges(F.col("v"), inner, lambda value, edge: value >= edge).alias("bin")
    side = lambda df, is_ref: df.select(F.col(value).cast("double").alias("v"), F.lit(is_ref).alias("ref")).filter("v IS NOT NULL")
    cells = side(reference, 1).unionByName(side(current, 0)).groupBy(slot).agg(
        F.count_if(F.col("ref") == 1).alias("r"), F.count_if(F.col("ref") == 0).alias("c"))
    totals = cells.agg(F.sum("r").alias("rt"), F.sum("c").alias("ct"), F.count(F.lit(1)).alias("k"))
    floor = F.lit(1e-6)
    shares = with_scalars(cells, totals).select(
        F.greatest(F.col("r") / F.col("rt"), floor).alias("a"), F.greatest(F.col("c") / F.col("ct"), floor).alias("b"))
    return shares.agg(F.sum((F.col("b") - F.col("a")) * F.ln(F.col("b") / F.col("a"))).alias("psi"))


# ----------------------------------------------------------------------------------------------
# Cost of a threshold
# ----------------------------------------------------------------------------------------------
def threshold_index(score: Column) -> Column:
    """Largest i with i * step <= score, from -1 to the last grid point."""
    guess = F.floor(score / F.lit(CURVE_STEP))
    guess = F.when((guess + 1) * F.lit(CURVE_STEP) <= score, guess + 1).when(guess * F.lit(CURVE_STEP) > score, guess - 1).otherwise(guess)
    return F.least(F.greatest(guess, F.lit(-1)), F.lit(specs.THRESHOLD_POINTS - 1)).cast("int")


def cost_curve(
    df: DataFrame, label: str, score: str, cost_fn: float = specs.COST_MISSED_FRAUD, cost_fp: float = specs.COST_FALSE_POSITIVE,
) -> DataFrame:
    """Cost and confusion counts at each of the grid's thresholds.

    Each row falls into one grid cell; suffix sums over the cells, at most 502 rows, replace
    comparing every row with every threshold.
    """
    rows = pairs(df, label, score)
    cells = rows.groupBy(threshold_index(F.col("score")).alias("i")).agg(
        F.count(F.lit(1)).alias("c"), F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("z"))
    spine = df.sparkSession.range(-1, specs.THRESHOLD_POINTS).select(F.col("id").cast("int").alias("i"))
    full = spine.join(cells, "i", "left").na.fill(0)
    above = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tp, fp = F.sum("p").over(above), F.sum("z").over(above)
    placed = full.select(
        "i", F.sum("c").over(above).alias("n_flagged"), tp.alias("true_positive"), fp.alias("false_positive"),
        (F.sum("p").over(every) - tp).alias("false_negative"), F.sum("c").over(every).alias("_n")).filter("i >= 0")
    total = F.col("false_negative") * F.lit(cost_fn) + F.col("false_positive") * F.lit(cost_fp)
    return placed.select(
        (F.col("i") * F.lit(CURVE_STEP)).alias("threshold"), "n_flagged", "true_positive", "false_positive", "false_negative",
        (F.col("true_positive") / (F.col("true_positive") + F.col("false_positive") + EPS)).alias("precision"),
        (F.col("true_positive") / (F.col("true_positive") + F.col("false_negative") + EPS)).alias("recall"),
        total.alias("total_cost"), (total / F.col("_n")).alias("cost_per_transaction"))


def optimal_threshold(
    df: DataFrame, label: str, score: str, costs: list[tuple[float, float]] | None = None,
) -> DataFrame:
    """Cheapest threshold with the two do-nothing baselines, for each (missed, false alarm) cost pair.

    All pairs are priced from one curve of counts, so no row is read twice.
    """
    costs = costs or [(specs.COST_MISSED_FRAUD, specs.COST_FALSE_POSITIVE)]
    curve = cost_curve(df, label, score)
    grid = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("fn"), F.lit(float(b)).alias("fp")) for a, b in costs]))
    priced = curve.withColumn("k", grid).select(
        F.col("k.fn").alias("cost_false_negative"), F.col("k.fp").alias("cost_false_positive"), "threshold", "n_flagged", "precision", "recall",
        (F.col("false_negative") * F.col("k.fn") + F.col("false_positive") * F.col("k.fp")).alias("total_cost"),
        (F.col("true_positive") + F.col("false_negative")).alias("_p"), F.when(F.col("threshold") == 0, F.col("n_flagged")).alias("_all"))
    best = priced.groupBy("cost_false_negative", "cost_false_positive").agg(
        F.min_by(F.struct("threshold", "total_cost", "n_flagged", "precision", "recall"), F.struct("total_cost", "threshold")).alias("b"),
        F.max("_p").alias("_p"), F.max("_all").alias("_n"))
    nothing, everything = F.col("_p") * F.col("cost_false_negative"), (F.col("_n") - F.col("_p")) * F.col("cost_false_positive")
    return best.select(
        "cost_false_negative", "cost_false_positive", "b.threshold", "b.total_cost", (F.col("b.total_cost") / F.col("_n")).alias("cost_per_transaction"),
        "b.n_flagged", "b.precision", "b.recall", nothing.alias("cost_flag_nothing"), everything.alias("cost_flag_everything"),
        (nothing - F.col("b.total_cost")).alias("saving_vs_flag_nothing"),
        (F.least(nothing, everything) - F.col("b.total_cost")).alias("saving_vs_best_baseline"))


# ----------------------------------------------------------------------------------------------
# Cross-sections and tests
# ----------------------------------------------------------------------------------------------
def daily_ic(df: DataFrame, truth: str, predicted: str, by: str, method: str = "spearman") -> DataFrame:
    """Correlation of outcome and prediction within each group; groups that cannot be ranked are left out."""
    rows = pairs(df, truth, predicted, by)
    y, p = "label", "score"
    if method == "spearman":
        rows = average_ranks(rows, [by], {"_ry": "label", "_rp": "score"}, pct=False)
        y, p = "_ry", "_rp"
    varied = lambda c: F.min(c) < F.max(c)
    per = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), varied("label").alias("_vy"), varied("score").alias("_vp"), safe_corr(y, p).alias("ic"))
    return per.filter((F.col("n") >= 3) & F.col("_vy") & F.col("_vp") & F.col("ic").isNotNull()).select(by, "n", "ic")


def rank_ic(df: DataFrame, truth: str, predicted: str, by: str, method: str = "spearman") -> DataFrame:
    """Mean, spread, ratio and hit rate of the per-group correlation."""
    agg = daily_ic(df, truth, predicted, by, method).agg(
        F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.avg((F.col("ic") > 1e-12).cast("double")).alias("hit_rate"),
        F.count(F.lit(1)).alias("n_dates"))
    return agg.withColumn("ic_ir", F.when(F.col("std_ic") > 0, F.col("mean_ic") / F.col("std_ic")))


def kupiec(exceptions, observations, confidence: float) -> dict[str, Column]:
    """Likelihood ratio and p-value of the share of exceptions against 1 - confidence."""
    x, n = (F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (exceptions, observations))
    q = 1.0 - confidence
    null = x * F.lit(math.log(q)) + (n - x) * F.lit(math.log(1 - q))
    alternative = F.coalesce(x * F.ln(x / n), F.lit(0.0)) + F.coalesce((n - x) * F.ln((n - x) / n), F.lit(0.0))
    lr = F.when(n > 0, F.lit(-2.0) * (null - alternative))
    return {
        "lr_statistic": lr, "p_value": erfc(F.sqrt(F.greatest(lr, F.lit(0.0)) / 2)),
        "observed_rate": safe_div(x, n), "expected_rate": F.lit(q)}


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count of a uniform number, by the cumulative probabilities as far as they differ from 1."""
    total, term, k, chain = math.exp(-1.0), math.exp(-1.0), 0, F.when(u < F.lit(math.exp(-1.0)), 0)
    while total + term / (k + 1) > total:
        k, term = k + 1, term / (k + 1)
        total += term
        chain = chain.when(u < F.lit(total), k)
    return chain.otherwise(k + 1)


def spread_pairs(df: DataFrame, label: str, score: str, key: str) -> tuple[DataFrame, int]:
    """Narrow rows dealt evenly over the cluster before each becomes many replicates, and their number.

    One replicate holds at most that many rows, so a small table needs no size check per replicate.
    """
    rows = pairs(df, label, score, key)
    return rows.repartition(split_settings(df.sparkSession).partitions, key), rows.count()


def bootstrap_auc(df: DataFrame, label: str, score: str, key: str, replicates: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile interval of the ROC-AUC from Poisson-weighted replicates.

    A row that a replicate does not draw is dropped before the shuffle, the rest is reduced to
    counts per (replicate, score) on the map side.
    """
    rows, n = spread_pairs(df, label, score, key)
    small = n <= split_settings(df.sparkSession).min_rows
    reps = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = reps.withColumn("w", poisson_weight(uniform(key, "rep", seed))).filter("w > 0")
    counts = materialise(score_counts(drawn, ["rep"], "w"), "replicates")  # drawn once, whatever reads the counts
    auc = ranked_counts(counts, ["rep"], bounded=small).filter("roc_auc IS NOT NULL")
    spread = auc.agg(
        F.percentile("roc_auc", alpha / 2).alias("lower"), F.percentile("roc_auc", 1 - alpha / 2).alias("upper"),
        F.stddev_samp("roc_auc").alias("std"), F.count(F.lit(1)).alias("n_boot"))
    return with_scalars(ranking_metrics(rows, "label", "score", total=n).select(F.col("roc_auc").alias("point")), spread)


#: Cells of the unit interval in which random numbers are counted before any is ordered.
CELLS = 1 << 12


def dealt_counts(reps: DataFrame, key: str, positives: int) -> DataFrame:
    """Per ``rep`` and score: the rows (``pos``) among the first ``positives`` by (``u``, key), and the others (``neg``).

    Random numbers are counted by cells; only those of the cell in which the last positive lies are ordered, as counts. Rows
    equal in number and key count by score, the lowest first.
    """
    celled = reps.withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    upto = F.sum("c").over(Window.partitionBy("rep").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = celled.groupBy("rep", "cell").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", upto)
    edge = cells.where((F.col("upto") >= positives) & (F.col("upto") - F.col("c") < positives))
    edge = materialise(edge.select("rep", F.col("cell").alias("edge"), (F.col("upto") - F.col("c")).alias("before")), "edges")  # one row per rep
    marked = celled.join(F.broadcast(edge), "rep", "left").withColumn("cut", F.coalesce(F.col("cell") == F.col("edge"), F.lit(False)))
    inside = lambda c: F.when(F.col("cut"), F.col(c))
    grouped = marked.groupBy("rep", "before", "score", "cut", inside("u").alias("u"), inside(key).alias("at")).agg(
        F.count(F.lit(1)).alias("c"), F.count_if(F.col("cell") < F.col("edge")).alias("sure"))
    grouped = materialise(grouped, "dealt")
    through = F.sum("c").over(Window.partitionBy("rep").orderBy("u", "at", "score").rowsBetween(Window.unboundedPreceding, 0))
    ordered = grouped.where("cut").withColumn("room", positives - F.col("before") - through + F.col("c"))
    taken = F.least(F.greatest(F.col("room"), F.lit(0)), F.col("c"))
    both = grouped.where("NOT cut").select("rep", "score", "c", "sure").unionByName(ordered.select("rep", "score", "c", taken.alias("sure")))
    return both.groupBy("rep", "score").agg(F.sum("sure").alias("pos"), (F.sum("c") - F.sum("sure")).alias("neg"))


def permutation_test(df: DataFrame, label: str, score: str, key: str, permutations: int = 200, seed: int = 42) -> DataFrame:
    """Chance of an AUC at least as large when the labels are dealt out at random, for a fixed score."""
    rows, n = spread_pairs(df, label, score, key)
    small = n <= split_settings(df.sparkSession).min_rows
    positives = int(rows.agg(F.count_if(F.col("label") > 0.5)).collect()[0][0])
    reps = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("u", uniform(key, "rep", seed))
    counts = materialise(dealt_counts(reps, key, positives), "permutations")
    null = ranked_counts(counts, ["rep"], bounded=small).select(F.col("roc_auc").alias("null_auc"))
    observed = ranking_metrics(rows, "label", "score", total=n).select(F.col("roc_auc").alias("observed"))
    both = with_scalars(null, observed)
    return both.groupBy("observed").agg(
        F.avg("null_auc").alias("null_mean"), F.percentile("null_auc", 0.95).alias("null_p95"),
        ((1 + F.count_if(F.col("null_auc") >= F.col("observed"))) / (1 + F.count("null_auc"))).alias("p_value"), F.count("null_auc").alias("n_permutations"))


# ----------------------------------------------------------------------------------------------
# Tables of results
# ----------------------------------------------------------------------------------------------
def metric_row(metrics: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """(keys, metric, value) rows become one row per key with a column per named metric."""
    return metrics.filter(F.col("metric").isin(names)).groupBy(*keys).pivot("metric", names).agg(F.max("value"))


def headline(metrics: DataFrame, task: str, keys: list[str]) -> DataFrame:
    return metric_row(metrics, specs.HEADLINE_METRICS[task], keys)


def leaderboard(runs: DataFrame) -> DataFrame:
    """Models of each module ranked by the module's own metric; runs without it are left out.

    ``runs`` has ``module``, ``model`` and a map ``metrics``.
    """
    default, default_up = specs.DEFAULT_PRIMARY_METRIC
    name = F.create_map(*[F.lit(x) for m, (metric, _) in specs.PRIMARY_METRIC.items() for x in (m, metric)])
    up = F.create_map(*[F.lit(x) for m, (_, higher) in specs.PRIMARY_METRIC.items() for x in (m, higher)])
    board = runs.select(
        "module", "model", F.coalesce(name[F.col("module")], F.lit(default)).alias("primary_metric"),
        F.coalesce(up[F.col("module")], F.lit(default_up)).alias("_up"), "metrics")
    board = board.withColumn("value", F.col("metrics")[F.col("primary_metric")]).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    best = F.when(F.col("_up"), -F.col("value")).otherwise(F.col("value"))
    rank = F.row_number().over(Window.partitionBy("module").orderBy(best, "model"))
    return board.select("module", "model", rank.alias("rank"), "primary_metric", "value")


def fold_summary(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and sample deviation over folds of (keys, fold, metric, value) rows."""
    return folds.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n_folds"))
