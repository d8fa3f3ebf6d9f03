"""Metrics of scores: ranking, probability, cost, drift, resampling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import metrics as m
from .registry import query

RANKED = """
h AS (SELECT {by} score, sum({w} * label) AS pos, sum({w} * (1 - label)) AS neg FROM {src} GROUP BY {by} score),
c AS (SELECT *, sum(pos) OVER {win} - pos AS tp, sum(neg) OVER {win} - neg AS fp, sum(pos) OVER {all} AS p, sum(neg) OVER {all} AS n FROM h),
metrics AS (SELECT {by} sum(pos * (n - fp - neg + neg / 2.0)) / (max(p) * max(n)) AS roc_auc, sum(pos * (tp + pos) / nullif(tp + pos + fp + neg, 0)) / max(p) AS pr_auc,
   max(abs((tp + pos) / p - (fp + neg) / n)) AS ks FROM c {group})
"""


def ranked(src="scored", by="", w="1"):
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    return RANKED.format(src=src, by=keys, w=w, win=f"({part}ORDER BY score DESC)", all=f"({part.strip()})", group=f"GROUP BY {by}" if by else "")


@query("roc_auc_ap_ks", f"WITH {ranked()} SELECT * FROM metrics", {"roc_auc": 9, "pr_auc": 9, "ks": 9})
def _(t):
    return m.ranking_metrics(t.scored, "label", "score")


@query("ranking_metrics_by_group", f"WITH {ranked(by='user_id')} SELECT * FROM metrics", {"roc_auc": 9, "pr_auc": 9, "ks": 9})
def _(t):
    return m.ranking_metrics(t.scored, "label", "score", ["user_id"])


@query(
    "ranking_metrics_null_group",
    f"""WITH kinds AS (SELECT label, score, CASE WHEN user_id % 5 = 0 THEN -1 ELSE user_id END AS g FROM scored), {ranked(src='kinds', by='g')}
        SELECT nullif(g, -1) AS user_id, roc_auc, pr_auc, ks FROM metrics""",
    {"roc_auc": 9, "pr_auc": 9, "ks": 9},
)
def _(t):
    """One of the groups has no key."""
    return m.ranking_metrics(t.scored.withColumn("user_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id"))), "label", "score", ["user_id"])


CONFUSION = """
b AS (SELECT avg((score - label) * (score - label)) AS brier,
   avg(-(label * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))) AS log_loss,
   CAST(count(*) FILTER (score >= 0.5 AND label = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (score >= 0.5 AND label = 0) AS DOUBLE) AS fp,
   CAST(count(*) FILTER (score < 0.5 AND label = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (score < 0.5 AND label = 0) AS DOUBLE) AS tn, count(*) AS n, sum(label) AS n_positive FROM scored),
b2 AS (SELECT *, tp / (tp + fp + 1e-15) AS precision, tp / (tp + fn + 1e-15) AS recall FROM b),
conf AS (SELECT brier, log_loss, (tp + tn) / n AS accuracy, precision, recall, 2 * precision * recall / (precision + recall + 1e-15) AS f1, tn / (tn + fp + 1e-15) AS specificity,
   n_positive / n AS base_rate, n, CAST(n_positive AS DOUBLE) AS n_positive FROM b2)
"""


@query(
    "probability_metrics", f"WITH {CONFUSION} SELECT * FROM conf",
    dict.fromkeys(("brier", "log_loss", "accuracy", "precision", "recall", "f1", "specificity", "base_rate", "n_positive"), 8),
)
def _(t):
    return m.probability_metrics(t.scored, "label", "score")


LIFT = """
o AS (SELECT label, row_number() OVER (ORDER BY score DESC, row_id) AS r, count(*) OVER () AS n, avg(label) OVER () AS base FROM scored),
lifts AS (SELECT share, max(greatest(1, round(n * share))) AS n_top, avg(label) FILTER (r <= greatest(1, round(n * share))) / max(base) AS lift FROM o, (SELECT unnest([0.05, 0.1, 0.2]) AS share) GROUP BY share)
"""


@query("lift_at_share", f"WITH {LIFT} SELECT CAST(share AS DOUBLE) AS share, CAST(n_top AS BIGINT) AS n_top, lift FROM lifts", {"share": 4, "lift": 8})
def _(t):
    return m.lift_at(t.scored, "label", "score", "row_id", [0.05, 0.10, 0.20])


@query(
    "binary_metric_bundle",
    f"""WITH {ranked()}, {CONFUSION}, {LIFT}
    SELECT metric, value FROM (UNPIVOT (SELECT roc_auc, pr_auc, ks, brier, log_loss, accuracy, precision, recall, f1, specificity, base_rate, CAST(n AS DOUBLE) AS n, n_positive FROM metrics, conf)
      ON COLUMNS(*) INTO NAME metric VALUE value)
    UNION ALL SELECT 'lift@' || CAST(round(share * 100) AS INT) || 'pct', lift FROM lifts""",
    {"value": 8},
)
def _(t):
    return m.binary_metrics(t.scored, "label", "score", "row_id")


@query(
    "gains_table",
    """WITH o AS (SELECT label, ntile(10) OVER (ORDER BY score DESC, row_id) AS decile FROM scored),
    g AS (SELECT decile, count(*) AS n, sum(label) AS e FROM o GROUP BY 1),
    c AS (SELECT *, sum(e) OVER (ORDER BY decile) AS ce, sum(n) OVER (ORDER BY decile) AS cn, sum(e) OVER () AS te, sum(n) OVER () AS tn FROM g)
    SELECT CAST(decile AS INT) AS decile, n, CAST(e AS BIGINT) AS n_events, e / n AS event_rate, CAST(ce AS BIGINT) AS cumulative_events, ce / te AS cumulative_capture,
      (e / n) / (te / tn) AS lift, (ce / cn) / (te / tn) AS cumulative_lift FROM c""",
    dict.fromkeys(("event_rate", "cumulative_capture", "lift", "cumulative_lift"), 8),
)
def _(t):
    return m.gains_table(t.scored, "label", "score", "row_id")


@query(
    "regression_metrics",
    """WITH e AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem), r AS (SELECT y, p - y AS e FROM e)
    SELECT sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, quantile_cont(abs(e), 0.5) AS medae, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2, avg(e) AS bias, count(*) AS n FROM r""",
    dict.fromkeys(("rmse", "mae", "medae", "r2", "bias"), 4),
)
def _(t):
    df = t.lineitem.withColumn("p", F.col("l_quantity") * 1500)
    return m.regression_metrics(df, "l_extendedprice", "p")


@query(
    "multiclass_metrics",
    """WITH d AS (SELECT Price_Move_Class AS t, CASE WHEN Trade_Volume < 12 THEN 'DOWN' WHEN Trade_Volume < 80 THEN 'FLAT' ELSE 'UP' END AS p FROM tape),
    c AS (SELECT unnest(['DOWN', 'FLAT', 'UP']) AS c),
    k AS (SELECT c, CAST(count(*) FILTER (t = c AND p = c) AS DOUBLE) AS tp, count(*) FILTER (t <> c AND p = c) AS fp, count(*) FILTER (t = c AND p <> c) AS fn FROM d, c GROUP BY c),
    s AS (SELECT c, tp / (tp + fp + 1e-15) AS pr, tp / (tp + fn + 1e-15) AS re FROM k), f AS (SELECT *, 2 * pr * re / (pr + re + 1e-15) AS f1 FROM s)
    SELECT 'accuracy' AS metric, avg(CASE WHEN t = p THEN 1 ELSE 0 END) AS value FROM d UNION ALL SELECT 'n', count(*) FROM d UNION ALL SELECT 'precision_' || c, pr FROM f
    UNION ALL SELECT 'recall_' || c, re FROM f UNION ALL SELECT 'f1_' || c, f1 FROM f UNION ALL SELECT 'macro_f1', avg(f1) FROM f UNION ALL SELECT 'balanced_accuracy', avg(re) FROM f""",
    {"value": 8},
)
def _(t):
    v = F.col("Trade_Volume")
    df = t.tape.withColumn("p", F.when(v < 12, "DOWN").when(v < 80, "FLAT").otherwise("UP"))
    return m.multiclass_metrics(df, "Price_Move_Class", "p")


CALIBRATION = """
e AS (SELECT list_sort(list_distinct(quantile_cont(score, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) AS edges FROM scored),
bn AS (SELECT CAST(least(greatest(len(list_filter(edges, lambda x: x <= score)), 1), len(edges) - 1) AS INT) AS bin, label, score FROM scored, e),
cal AS (SELECT bin, count(*) AS n, avg(score) AS mean_predicted, avg(label) AS observed_rate, avg(label) - avg(score) AS gap FROM bn GROUP BY bin)
"""
CAL_OUT = {"mean_predicted": 8, "observed_rate": 8, "gap": 8}


@query("calibration_table", f"WITH {CALIBRATION} SELECT * FROM cal", CAL_OUT)
def _(t):
    return m.calibration_table(t.scored, "label", "score")


@query(
    "calibration_equal_width",
    """WITH r AS (SELECT min(score) AS lo, max(score) AS hi FROM scored),
    e AS (SELECT list_transform(range(11), lambda i: lo + (hi - lo) * i / 10) AS edges FROM r),
    b AS (SELECT CAST(least(greatest(len(list_filter(edges, lambda x: x <= score)), 1), 10) AS INT) AS bin, label, score FROM scored, e)
    SELECT bin, count(*) AS n, avg(score) AS mean_predicted, avg(label) AS observed_rate, avg(label) - avg(score) AS gap FROM b GROUP BY bin""",
    CAL_OUT,
)
def _(t):
    return m.calibration_table(t.scored, "label", "score", strategy="width")


@query("expected_calibration_error", f"WITH {CALIBRATION} SELECT sum(n * abs(gap)) / sum(n) AS ece FROM cal", {"ece": 8})
def _(t):
    return m.expected_calibration_error(m.calibration_table(t.scored, "label", "score"))


CURVE = """
g AS (SELECT i, i * 0.002e0 AS threshold FROM (SELECT unnest(range(501)) AS i)),
hs AS (SELECT score, count(*) AS k, sum(label) AS p FROM scored GROUP BY 1),
tot AS (SELECT count(*) AS n, sum(label) AS p FROM scored),
cu AS (SELECT threshold, coalesce(sum(k), 0) AS n_flagged, coalesce(sum(hs.p), 0) AS tp, coalesce(sum(k) - sum(hs.p), 0) AS fp FROM g LEFT JOIN hs ON score >= threshold GROUP BY threshold),
curve AS (SELECT threshold, n_flagged, tp, fp, tot.p - tp AS fn, tot.n AS n, tot.p AS p FROM cu, tot)
"""
CURVE_OUT = {"threshold": 6, "precision": 8, "recall": 8, "total_cost": 2, "cost_per_transaction": 6}


@query(
    "cost_curve",
    f"""WITH {CURVE} SELECT threshold, CAST(n_flagged AS BIGINT) AS n_flagged, CAST(tp AS BIGINT) AS true_positive, CAST(fp AS BIGINT) AS false_positive, CAST(fn AS BIGINT) AS false_negative,
      tp / (tp + fp + 1e-15) AS precision, tp / (tp + fn + 1e-15) AS recall, fn * 10000e0 + fp * 500e0 AS total_cost, (fn * 10000e0 + fp * 500e0) / n AS cost_per_transaction FROM curve""",
    CURVE_OUT,
)
def _(t):
    return m.cost_curve(t.scored, "label", "score")


BEST_OUT = dict.fromkeys(
    ("cost_false_negative", "cost_false_positive", "total_cost", "cost_flag_nothing", "cost_flag_everything", "saving_vs_flag_nothing", "saving_vs_best_baseline"), 2,
) | {"threshold": 6, "precision": 8, "recall": 8, "cost_per_transaction": 6}
BEST = """
priced AS (SELECT cfn AS cost_false_negative, cfp AS cost_false_positive, *, fn * cfn + fp * cfp AS total_cost FROM curve, costs),
best AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY cost_false_negative, cost_false_positive ORDER BY total_cost, threshold) = 1)
SELECT cost_false_negative, cost_false_positive, threshold, total_cost, total_cost / n AS cost_per_transaction, CAST(n_flagged AS BIGINT) AS n_flagged, tp / (tp + fp + 1e-15) AS precision,
  tp / (tp + fn + 1e-15) AS recall, p * cfn AS cost_flag_nothing, (n - p) * cfp AS cost_flag_everything, p * cfn - total_cost AS saving_vs_flag_nothing,
  least(p * cfn, (n - p) * cfp) - total_cost AS saving_vs_best_baseline FROM best
"""


@query("optimal_threshold", f"WITH {CURVE}, costs AS (SELECT 10000e0 AS cfn, 500e0 AS cfp), {BEST}", BEST_OUT)
def _(t):
    return m.optimal_threshold(t.scored, "label", "score")


@query(
    "cost_repricing_sweep",
    f"WITH {CURVE}, costs AS (SELECT unnest([1000e0, 5000e0, 10000e0, 25000e0]) AS cfn, 500e0 AS cfp UNION ALL SELECT 10000e0, 2000e0), {BEST}", BEST_OUT,
)
def _(t):
    return m.optimal_threshold(t.scored, "label", "score", [(1000, 500), (5000, 500), (10000, 500), (25000, 500), (10000, 2000)])


IC = """
k AS (SELECT Date, (rank() OVER (PARTITION BY Date ORDER BY Return) + (count(*) OVER (PARTITION BY Date, Return) - 1) / 2.0) AS ry,
   (rank() OVER (PARTITION BY Date ORDER BY Momentum_20D) + (count(*) OVER (PARTITION BY Date, Momentum_20D) - 1) / 2.0) AS rp, Return, Momentum_20D FROM market),
ics AS (SELECT Date, count(*) AS n, corr(ry, rp) AS ic FROM k GROUP BY Date HAVING count(*) >= 3 AND min(Return) < max(Return) AND min(Momentum_20D) < max(Momentum_20D))
"""


@query("daily_rank_ic", f"WITH {IC} SELECT * FROM ics", {"ic": 8})
def _(t):
    return m.daily_ic(t.market, "Return", "Momentum_20D", "Date")


@query(
    "rank_ic",
    f"WITH {IC} SELECT avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(CASE WHEN ic > 1e-12 THEN 1 ELSE 0 END) AS hit_rate, count(*) AS n_dates, avg(ic) / stddev_samp(ic) AS ic_ir FROM ics",
    {"mean_ic": 8, "std_ic": 8, "hit_rate": 4, "ic_ir": 6},
)
def _(t):
    return m.rank_ic(t.market, "Return", "Momentum_20D", "Date")


@query(
    "population_stability",
    """WITH r AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00'), c AS (SELECT value + 5 AS value FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'),
    e AS (SELECT list_sort(list_distinct(quantile_cont(value, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1])))[2:-2] AS inner_edges FROM r),
    b AS (SELECT len(list_filter(inner_edges, lambda x: x <= value)) AS bin, 1 AS a, 0 AS z FROM r, e UNION ALL SELECT len(list_filter(inner_edges, lambda x: x <= value)), 0, 1 FROM c, e),
    s AS (SELECT bin, greatest(sum(a) / (SELECT count(*) FROM r), 1e-6) AS a, greatest(sum(z) / (SELECT count(*) FROM c), 1e-6) AS z FROM b GROUP BY bin)
    SELECT sum((z - a) * ln(z / a)) AS psi FROM s""",
    {"psi": 8},
)
def _(t):
    cut = "TIMESTAMP '2024-01-20 00:00:00'"
    current = t.events.filter(f"ts >= {cut}").withColumn("value", F.col("value") + 5)
    return m.population_stability(t.events.filter(f"ts < {cut}"), current, "value")


POISSON = "CASE " + " ".join(
    f"WHEN u < {math.fsum(math.exp(-1) / math.factorial(i) for i in range(k + 1))!r} THEN {k}" for k in range(17)) + " ELSE 17 END"


@query(
    "bootstrap_interval",
    f"""WITH dr AS (SELECT rep, label, score, {POISSON} AS w FROM (SELECT rep, label, score,
         CAST(('0x' || substr(md5(concat_ws(':', CAST(row_id AS VARCHAR), CAST(rep AS VARCHAR), '42')), 1, 13)) AS BIGINT) / 4503599627370496 AS u FROM scored, (SELECT unnest(range(1, 41)) AS rep))),
    {ranked(src='dr', by='rep', w='w')},
    pt AS (SELECT sum(q.pos * (q.n - q.fp - q.neg + q.neg / 2.0)) / (max(q.p) * max(q.n)) AS point FROM (SELECT *, sum(neg) OVER (ORDER BY score DESC) - neg AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
       FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score)) q)
    SELECT max(point) AS point, quantile_cont(roc_auc, 0.025) AS lower, quantile_cont(roc_auc, 0.975) AS upper, stddev_samp(roc_auc) AS std, count(*) AS n_boot FROM metrics, pt""",
    {"point": 8, "lower": 8, "upper": 8, "std": 8},
)
def _(t):
    return m.bootstrap_auc(t.scored, "label", "score", "row_id", replicates=40)


@query(
    "permutation_test",
    f"""WITH rp AS (SELECT rep, row_id, score, CAST(('0x' || substr(md5(concat_ws(':', CAST(row_id AS VARCHAR), CAST(rep AS VARCHAR), '42')), 1, 13)) AS BIGINT) / 4503599627370496 AS u
       FROM scored, (SELECT unnest(range(1, 41)) AS rep)),
    dl AS (SELECT rep, score, CASE WHEN row_number() OVER (PARTITION BY rep ORDER BY u, row_id) <= (SELECT sum(label) FROM scored) THEN 1 ELSE 0 END AS label FROM rp),
    {ranked(src='dl', by='rep')},
    ob AS (SELECT sum(q.pos * (q.n - q.fp - q.neg + q.neg / 2.0)) / (max(q.p) * max(q.n)) AS observed FROM (SELECT *, sum(neg) OVER (ORDER BY score DESC) - neg AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
       FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score)) q)
    SELECT observed, avg(roc_auc) AS null_mean, quantile_cont(roc_auc, 0.95) AS null_p95, (1 + count(*) FILTER (roc_auc >= observed)) / (1 + count(*)) AS p_value, count(*) AS n_permutations FROM metrics, ob GROUP BY observed""",
    {"observed": 8, "null_mean": 8, "null_p95": 8, "p_value": 8},
)
def _(t):
    return m.permutation_test(t.scored, "label", "score", "row_id", permutations=40)


def _runs(t):
    """One run per event type: its amount as a score of two labels, with their metrics."""
    base = t.scored.withColumn("half", F.when(F.hour("ts") < 12, "am").otherwise("pm"))
    ranking = m.ranking_metrics(base, "label", "score", ["half"])
    return ranking.selectExpr("half", "stack(3, 'roc_auc', roc_auc, 'pr_auc', pr_auc, 'ks', ks) AS (metric, value)")


HALVES = ranked(src="(SELECT CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS half, label, score FROM scored)", by="half")


@query("headline_metrics", f"WITH {HALVES} SELECT half, roc_auc, pr_auc, CAST(NULL AS DOUBLE) AS brier FROM metrics", {"roc_auc": 8, "pr_auc": 8, "brier": 8})
def _(t):
    return m.headline(_runs(t), "binary_classification", ["half"])


@query("metric_pivot", f"WITH {HALVES} SELECT half, ks, pr_auc FROM metrics", {"ks": 8, "pr_auc": 8})
def _(t):
    return m.metric_row(_runs(t), ["ks", "pr_auc"], ["half"])


DAYS = ranked(src="(SELECT CAST(ts AS DATE) AS fold, label, score FROM scored)", by="fold")


@query(
    "fold_summary",
    f"""WITH {DAYS}, l AS (SELECT 'roc_auc' AS metric, roc_auc AS value FROM metrics UNION ALL SELECT 'pr_auc', pr_auc FROM metrics UNION ALL SELECT 'ks', ks FROM metrics)
    SELECT metric, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n_folds FROM l GROUP BY metric""",
    {"mean": 8, "std": 8},
)
def _(t):
    df = t.scored.withColumn("fold", F.to_date("ts"))
    long = m.ranking_metrics(df, "label", "score", ["fold"]).selectExpr("fold", "stack(3, 'roc_auc', roc_auc, 'pr_auc', pr_auc, 'ks', ks) AS (metric, value)")
    return m.fold_summary(long, [])


MODULES_SQL = """CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'loans' WHEN 1 THEN 'transactions' WHEN 2 THEN 'customers' ELSE 'other' END"""


@query(
    "leaderboard",
    f"""WITH {ranked(src=f"(SELECT {MODULES_SQL} || ':' || CASE WHEN hour(ts) < 8 THEN 'night' WHEN hour(ts) < 16 THEN 'day' ELSE 'evening' END AS run, label, score FROM scored)", by="run")},
    b AS (SELECT split_part(run, ':', 1) AS module, split_part(run, ':', 2) AS model, roc_auc, pr_auc, ks FROM metrics),
    v AS (SELECT module, model, CASE module WHEN 'loans' THEN 'ks' WHEN 'other' THEN 'roc_auc' ELSE 'pr_auc' END AS primary_metric,
       CASE module WHEN 'loans' THEN ks WHEN 'other' THEN roc_auc ELSE pr_auc END AS value FROM b)
    SELECT module, model, CAST(row_number() OVER (PARTITION BY module ORDER BY value DESC, model) AS INT) AS rank, primary_metric, value FROM v""",
    {"value": 8},
)
def _(t):
    hour, u = F.hour("ts"), F.col("user_id") % 4
    df = t.scored.withColumns({
        "module": F.when(u == 0, "loans").when(u == 1, "transactions").when(u == 2, "customers").otherwise("other"),
        "model": F.when(hour < 8, "night").when(hour < 16, "day").otherwise("evening")})
    runs = m.ranking_metrics(df, "label", "score", ["module", "model"])
    names = ("roc_auc", "pr_auc", "ks")
    return m.leaderboard(runs.select("module", "model", F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("metrics")))
