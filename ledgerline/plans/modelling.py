"""Fits, out-of-fold scores, selection and attribution on the loan and order-book tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import safe_corr
from ..operators import features as fx
from ..operators import metrics as m
from ..operators import modeling as ml
from ..operators import money, splits
from ..session import fresh_dir, materialise
from .registry import query

NUMERIC = ["ltv", "loan_to_income", "credit_score_norm", "Debt_to_Income", "Past_Default", "Sector_Risk", "emi_to_monthly_income", "pd"]
CATEGORICAL = ["Customer_Type", "credit_band"]
LOGISTIC = ml.BASELINES["binary"][1]


def loans(t, folds=3):
    """Loan features with a fold of each row."""
    df = fx.credit_features(t.loans).withColumn("label", F.col("Default_Flag").cast("double"))
    assigned = splits.stratified_folds(t.loans, "Customer_ID", "Default_Flag", folds).select("Customer_ID", "fold")
    return df.select("Customer_ID", "label", "Loan_Amount", "Collateral_Value", "o_orderdate", *NUMERIC, *CATEGORICAL).join(assigned, "Customer_ID")


def table(t, folds=3):
    return materialise(loans(t, folds), "loans", spread=True)


def oof(t, model=LOGISTIC, folds=3):
    return ml.out_of_fold(table(t, folds), model, ml.kfold_roles("fold", folds), ["Customer_ID"], NUMERIC, CATEGORICAL)


@query("fold_safe_preprocessing", None, {"mean_first": 6})
def _(t):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    rows = ml.prepare(table(t), NUMERIC)
    fitted = Pipeline(stages=ml.preprocessing(NUMERIC, CATEGORICAL, True)).fit(rows.filter("fold <> 1"))
    out = fitted.transform(rows.filter("fold = 1")).withColumn("v", vector_to_array("features"))
    return out.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("v")[0]).alias("mean_first"))


@query("out_of_fold_scores", None, {"label": 1, "score": 6})
def _(t):
    return oof(t)


@query(
    "out_of_fold_coverage", "SELECT o_orderstatus = 'F' AS positive, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys FROM orders GROUP BY 1",
)
def _(t):
    return oof(t).groupBy((F.col("label") == 1).alias("positive")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("Customer_ID").alias("n_keys"))


@query(
    "baseline_prior",
    """WITH st AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, ntile(3) OVER (PARTITION BY o_orderstatus = 'F' ORDER BY CAST(('0x' || substr(md5(concat_ws(':', CAST(o_orderkey AS VARCHAR), '1', '42')), 1, 13)) AS BIGINT) / 4503599627370496, o_orderkey) AS fold FROM orders),
    c AS (SELECT fold, count(*) AS n, sum(y) AS s FROM st GROUP BY 1)
    SELECT CAST(fold AS INT) AS fold, n, ((SELECT sum(s) FROM c) - s) / ((SELECT sum(n) FROM c) - n) AS score FROM c""",
    {"score": 8},
)
def _(t):
    return oof(t, ml.BASELINES["binary"][0]).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))


@query("model_comparison_binary", None, {"mean": 6, "std": 6})
def _(t):
    models = [*ml.BASELINES["binary"], ml.Model("logistic_balanced", "logistic", params={"regParam": 0.01, "maxIter": 50}, scale=True, balanced=True)]
    return ml.compare(loans(t), models, ml.kfold_roles("fold", 3), ["Customer_ID"], NUMERIC, CATEGORICAL)


@query("model_comparison_regression", None, {"mean": 6, "std": 6})
def _(t):
    numeric = ["moneyness", "sqrt_time", "total_variance", "discount_factor", "Spot", "Strike"]
    df = fx.option_features(t.options).withColumn("label", F.col("Market_Price")).withColumn("fold", splits.group_fold(["Underlying", "expiry_bucket"], 3))
    return ml.compare(df.select("Option_ID", "label", "fold", "Option_Type", *numeric), ml.BASELINES["regression"], ml.kfold_roles("fold", 3), ["Option_ID"], numeric, ["Option_Type"])


@query("model_comparison_multiclass", None, {"mean": 6, "std": 6})
def _(t):
    numeric = ["spread_bps", "depth_imbalance_1", "obi_lag_1", "obi_mean_10", "mid_vs_mean_bps", "buy_pressure_20"]
    df = fx.tape_features(t.tape)
    label = F.when(F.col("Price_Move_Class") == "DOWN", 0.0).when(F.col("Price_Move_Class") == "FLAT", 1.0).otherwise(2.0)
    df, _ = splits.value_axis(df.withColumn("label", label), "Trading_Day")
    fold = splits.Fold(1, 12, 12, 16)
    roles = [ml.FoldRole(1, fold.is_train(), fold.is_test())]
    return ml.compare(df.select("seq", "label", splits.AXIS, "Trade_Side", *numeric), ml.BASELINES["multiclass"], roles, ["seq"], numeric, ["Trade_Side"])


@query("out_of_fold_evaluation", None, {"value": 6})
def _(t):
    scores = materialise(oof(t), "oof")
    bundle = m.binary_metrics(scores, "label", "score", "Customer_ID")
    best = m.optimal_threshold(scores, "label", "score").selectExpr("stack(2, 'optimal_threshold', threshold, 'total_cost', total_cost) AS (metric, value)")
    ece = m.expected_calibration_error(m.calibration_table(scores, "label", "score")).selectExpr("'ece' AS metric", "ece AS value")
    return bundle.unionByName(best).unionByName(ece)


@query("batch_scoring", None, {"pd": 6, "ecl": 2, "ecl_ratio": 6, "ecl_collateral_aware": 2})
def _(t):
    path = fresh_dir(t.spark, "model")
    df = table(t).drop("pd")
    numeric = [c for c in NUMERIC if c != "pd"]
    ml.refit_and_save(df.filter("fold <> 1"), LOGISTIC, numeric, CATEGORICAL, path)
    scored = ml.score_batch(df.filter("fold = 1"), path, ["Customer_ID", "Loan_Amount", "Collateral_Value"]).withColumnRenamed("score", "pd")
    return money.score_credit(scored).select("Customer_ID", "pd", "ecl", "ecl_ratio", "risk_band", "decision", "ecl_collateral_aware")


@query("holdout_scored_once", None, dict.fromkeys(("realised_cost", "cost_per_row"), 2) | dict.fromkeys(("psi", "roc_auc", "pr_auc", "ks", "threshold"), 6))
def _(t):
    df = table(t)
    cut = "o_orderdate < TIMESTAMP '2000-06-01 00:00:00'"
    return ml.holdout_once(df.filter(cut), df.filter(f"NOT ({cut})"), LOGISTIC, ml.kfold_roles("fold", 3), ["Customer_ID"], NUMERIC, CATEGORICAL, fresh_dir(t.spark, "holdout"))


@query("stacked_scores", None, {"roc_auc": 6, "pr_auc": 6, "ks": 6})
def _(t):
    models = [LOGISTIC, ml.BASELINES["binary"][2]]
    scores = materialise(ml.stacked(loans(t), models, ml.kfold_roles("fold", 3), "Customer_ID", NUMERIC, CATEGORICAL), "stacked")
    out = m.ranking_metrics(scores, "label", "score").withColumn("model", F.lit("stack"))
    for i, model in enumerate(models):
        out = out.unionByName(m.ranking_metrics(scores, "label", f"s{i}").withColumn("model", F.lit(model.name)))
    return out


@query("parameter_search", None, {"value": 6})
def _(t):
    space = {"regParam": [0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]}
    return ml.parameter_search(loans(t, 2), LOGISTIC, space, 4, ml.kfold_roles("fold", 2), ["Customer_ID"], NUMERIC, CATEGORICAL)


@query("permutation_importance", None, {"importance_mean": 6, "importance_std": 6})
def _(t):
    df = ml.prepare(table(t), NUMERIC)
    fitted = ml.fit(LOGISTIC, df.filter("fold <> 1"), NUMERIC, CATEGORICAL)
    return ml.permutation_importance(df.filter("fold = 1"), fitted, "Customer_ID", ["pd", "ltv", "Sector_Risk"], repeats=3)


@query("null_importance", None, dict.fromkeys(("actual_importance", "null_mean", "null_cut", "gain_over_null"), 6))
def _(t):
    return ml.null_importance(loans(t).filter("fold <> 1"), "Customer_ID", ["pd", "ltv", "Sector_Risk", "Debt_to_Income"], runs=5)


@query("feature_selection")
def _(t):
    df = table(t).filter("fold <> 1").withColumn("constant", F.lit(1.0)).withColumn("pd_copy", F.col("pd") * 2)
    return ml.select_features(df, "Customer_ID", ["pd", "pd_copy", "ltv", "Sector_Risk", "constant"], ["Customer_Type"], runs=4, priority={"pd"})


COEF = {"pd": 1.2, "Debt_to_Income": 0.4, "Sector_Risk": -0.3, "Interest_Rate": 0.7}
CENTRE = {"pd": 0.15, "Debt_to_Income": 0.48, "Sector_Risk": 0.5, "Interest_Rate": 10.0}
SPREAD = {"pd": 0.1, "Debt_to_Income": 0.28, "Sector_Risk": 0.29, "Interest_Rate": 3.0}


@query(
    "row_attribution",
    "WITH c AS (" + " UNION ALL ".join(
        f"SELECT Customer_ID, '{f}' AS feature, {b}::DOUBLE * ({f} - {CENTRE[f]}::DOUBLE) / {SPREAD[f]}::DOUBLE AS contribution FROM loans" for f, b in COEF.items())
    + """), r AS (SELECT *, row_number() OVER (PARTITION BY Customer_ID ORDER BY abs(contribution) DESC, feature) AS rank FROM c)
    SELECT Customer_ID, CAST(rank AS INT) AS rank, feature, contribution, CASE WHEN contribution > 0 THEN 'increases risk' ELSE 'reduces risk' END AS direction FROM r WHERE rank <= 2""",
    {"contribution": 8},
)
def _(t):
    return ml.linear_contributions(t.loans, "Customer_ID", COEF, CENTRE, SPREAD, top=2)


_IMP = ["pd", "Interest_Rate", "Sector_Risk", "Debt_to_Income", "Loan_Amount"]


@query(
    "importance_stack",
    "WITH i AS (" + " UNION ALL ".join(f"SELECT Segment AS module, '{f}' AS feature, abs(corr({f}, Default_Flag)) AS importance FROM loans GROUP BY 1" for f in _IMP)
    + ") SELECT module, feature, importance, CAST(row_number() OVER (PARTITION BY module ORDER BY importance DESC, feature) AS INT) AS rank FROM i QUALIFY rank <= 3",
    {"importance": 8},
)
def _(t):
    wide = t.loans.groupBy(F.col("Segment").alias("module")).agg(*[F.abs(safe_corr(f, "Default_Flag")).alias(f) for f in _IMP])
    cells = ", ".join(f"'{f}', `{f}`" for f in _IMP)
    return ml.importance_stack(wide.selectExpr("module", f"stack({len(_IMP)}, {cells}) AS (feature, importance)"), top=3)
