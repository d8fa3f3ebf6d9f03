"""Fitting and scoring with MLlib: leak-safe preprocessing, out-of-fold scores, selection, stacking."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StandardScalerModel, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import matched, uniform, with_scalars
from ..session import materialise
from ..sources import tables
from . import encode, metrics
from .ordered import row_position

PARALLEL_FITS = 4


# ----------------------------------------------------------------------------------------------
# Estimators
# ----------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Model:
    """A named estimator for one task; ``prior`` is the trivial baseline without features."""

    name: str
    kind: str
    task: str = "binary"
    params: dict = field(default_factory=dict)
    scale: bool = False
    balanced: bool = False

    def estimator(self, weight: str | None = None, layers: list[int] | None = None):
        makers = {
            ("logistic", "binary"): LogisticRegression, ("logistic", "multiclass"): LogisticRegression,
            ("forest", "binary"): RandomForestClassifier, ("forest", "multiclass"): RandomForestClassifier,
            ("boosted", "binary"): GBTClassifier, ("mlp", "multiclass"): MultilayerPerceptronClassifier,
            ("mlp", "binary"): MultilayerPerceptronClassifier, ("linear", "regression"): LinearRegression,
            ("forest", "regression"): RandomForestRegressor, ("boosted", "regression"): GBTRegressor,
        }
        if (self.kind, self.task) not in makers:
            raise ValueError(f"no {self.kind} estimator for {self.task}")
        extra = dict(self.params)
        if weight and self.kind != "mlp":
            extra["weightCol"] = weight
        if self.kind == "mlp":
            extra.setdefault("layers", layers)
        if self.kind in ("forest", "boosted", "mlp"):
            extra.setdefault("seed", 42)
        return makers[self.kind, self.task](featuresCol="features", labelCol="label", **extra)


BASELINES: dict[str, list[Model]] = {
    "binary": [
        Model("dummy_prior", "prior"),
        Model("logistic_l2", "logistic", params={"regParam": 0.01, "maxIter": 50}, scale=True),
        Model("random_forest", "forest", params={"numTrees": 20, "maxDepth": 5, "minInstancesPerNode": 20}),
        Model("boosted_trees", "boosted", params={"maxIter": 10, "maxDepth": 3, "stepSize": 0.2}),
    ],
    "multiclass": [
        Model("dummy_prior", "prior", "multiclass"),
        Model("logistic_l2", "logistic", "multiclass", {"regParam": 0.01, "maxIter": 50}, scale=True),
        Model("random_forest", "forest", "multiclass", {"numTrees": 20, "maxDepth": 5}),
        Model("mlp", "mlp", "multiclass", {"maxIter": 30}, scale=True),
    ],
    "regression": [
        Model("dummy_mean", "prior", "regression"),
        Model("ridge", "linear", "regression", {"regParam": 1.0, "elasticNetParam": 0.0}, scale=True),
        Model("elastic_net", "linear", "regression", {"regParam": 0.1, "elasticNetParam": 0.5}, scale=True),
        Model("random_forest", "forest", "regression", {"numTrees": 20, "maxDepth": 5}),
        Model("boosted_trees", "boosted", "regression", {"maxIter": 10, "maxDepth": 3}),
    ],
}


def preprocessing(numeric: list[str], categorical: list[str], scale: bool) -> list:
    """Unfitted stages: median imputation, optional scaling, one-hot with unseen values ignored.

    They belong to the same pipeline as the estimator, so every fold fits its own.
    """
    stages, parts = [], []
    if numeric:
        filled = [f"{c}__n" for c in numeric]
        stages += [
            Imputer(strategy="median", relativeError=1e-4, inputCols=numeric, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="_numbers")]
        parts.append("_numbers")
        if scale:
            stages.append(StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True))
            parts[-1] = "_scaled"
    if categorical:
        indexed, coded = [f"{c}__i" for c in categorical], [f"{c}__o" for c in categorical]
        stages += [
            StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=coded, handleInvalid="keep")]
        parts += coded
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def prepare(df: DataFrame, numeric: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in numeric})


def balanced_weights(train: DataFrame, label: str) -> DataFrame:
    """Weight rows so that every class counts the same, for any number of classes; NULL without a label."""
    counts = train.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    sized = with_scalars(counts, counts.agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_k")))
    weights = sized.select(label, (F.col("_total") / (F.col("_k") * F.col("_n"))).alias("_weight"))
    return matched(train, weights, [label], "left", broadcast=True)  # a row per class; dealt by class, rows would meet in a few tasks


def unscaled(ready: PipelineModel) -> PipelineModel:
    """Fitted preprocessing without its scaler: what a fit without one gives on the same rows."""
    *stages, last = [s for s in ready.stages if not isinstance(s, StandardScalerModel)]
    parts = ["_numbers" if c == "_scaled" else c for c in last.getInputCols()]
    return PipelineModel([*stages, VectorAssembler(inputCols=parts, outputCol="features")])


def fit(model: Model, train: DataFrame, numeric: list[str], categorical: list[str], ready: PipelineModel | None = None):
    """Fitted pipeline; a constant for the trivial baseline. ``ready``: preprocessing already fitted on the same rows."""
    if model.kind == "prior":
        if model.task == "multiclass":
            top = train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "label").first()
            return float(top["label"])
        return train.agg(F.avg("label")).first()[0]
    weight = "_weight" if model.balanced else None
    rows = balanced_weights(train, "label") if weight else train
    ready = ready or Pipeline(stages=preprocessing(numeric, categorical, model.scale)).fit(rows)
    layers = None
    if model.kind == "mlp" and "layers" not in model.params:
        width = ready.transform(rows.limit(1)).first()["features"].size
        layers = [width, 16, int(rows.agg(F.max("label")).first()[0]) + 1]
    return PipelineModel([*ready.stages, model.estimator(weight, layers).fit(ready.transform(rows))])


def predict(fitted, df: DataFrame, task: str, keep: list[str]) -> DataFrame:
    """Scores of rows: probability of the positive class, class number, or value."""
    if not isinstance(fitted, PipelineModel):
        return df.select(*keep, F.lit(float(fitted)).alias("score"))
    out = fitted.transform(df)
    score = vector_to_array("probability")[1] if task == "binary" else F.col("prediction")
    return out.select(*keep, score.alias("score"))


# ----------------------------------------------------------------------------------------------
# Cross-validation
# ----------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class FoldRole:
    """Train and test rows of one fold as conditions on the feature table."""

    fold: int
    train: Column
    test: Column


def kfold_roles(fold_column: str, folds: int) -> list[FoldRole]:
    return [FoldRole(k, F.col(fold_column) != k, F.col(fold_column) == k) for k in range(1, folds + 1)]


def in_parallel(jobs: list[Callable]) -> list:
    """Run driver-side fits side by side; each is a Spark job of its own."""
    inherit = inheritable_thread_target(SparkSession.active())
    wrapped = [inherit(job) for job in jobs]
    with ThreadPool(min(PARALLEL_FITS, max(len(jobs), 1))) as pool:
        return pool.map(lambda job: job(), wrapped)


def fold_preprocessing(
    df: DataFrame, models: list[Model], roles: list[FoldRole], numeric: list[str], categorical: list[str],
) -> dict[tuple[int, bool], PipelineModel]:
    """Preprocessing of each fold, fitted on its training rows once for all models, by fold and whether it scales."""
    rows, scales = prepare(df, numeric), {m.scale for m in models if m.kind != "prior"}

    def one(role: FoldRole) -> dict[tuple[int, bool], PipelineModel]:
        whole = Pipeline(stages=preprocessing(numeric, categorical, max(scales))).fit(rows.filter(role.train))
        return {(role.fold, s): whole if s == max(scales) else unscaled(whole) for s in scales}

    parts = in_parallel([lambda role=role: one(role) for role in roles]) if scales else []
    return {k: v for part in parts for k, v in part.items()}


def out_of_fold(
    df: DataFrame, model: Model, roles: list[FoldRole], key: list[str], numeric: list[str], categorical: list[str],
    on_fold: Callable[[int, DataFrame], None] | None = None, ready: dict[tuple[int, bool], PipelineModel] | None = None,
) -> DataFrame:
    """Scores of every row by a model that never saw it: (key, fold, label, score).

    Every fit scans ``df`` again, so pass a written table (``session.materialise``), not a long
    lineage. ``ready`` is the outcome of ``fold_preprocessing`` where several models share it.
    """
    rows = prepare(df, numeric)

    def one(role: FoldRole) -> DataFrame:
        fitted = fit(model, rows.filter(role.train), numeric, categorical, (ready or {}).get((role.fold, model.scale)))
        scored = predict(fitted, rows.filter(role.test), model.task, [*key, "label"])
        scored = scored.withColumn("fold", F.lit(role.fold))
        if on_fold:
            on_fold(role.fold, scored)
        return scored

    parts = in_parallel([lambda role=role: one(role) for role in roles])
    return reduce(lambda a, b: a.unionByName(b), parts)


def fold_metrics(oof: DataFrame, task: str) -> DataFrame:
    """(fold, metric, value) of out-of-fold scores."""
    oof = materialise(oof, "fold-scores")  # models score each row once, however often scores are read
    if task == "binary":
        wide = metrics.ranking_metrics(oof, "label", "score", ["fold"]).join(metrics.probability_metrics(oof, "label", "score", ["fold"]), "fold")
    elif task == "regression":
        wide = metrics.regression_metrics(oof, "label", "score", ["fold"])
    else:
        wide = oof.groupBy("fold").agg(F.avg((F.col("label") == F.col("score")).cast("double")).alias("accuracy"))
    names = [c for c in wide.columns if c != "fold"]
    cells = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)
    return wide.selectExpr("fold", f"stack({len(names)}, {cells}) AS (metric, value)")


def compare(df: DataFrame, models: list[Model], roles: list[FoldRole], key: list[str], numeric: list[str], categorical: list[str]) -> DataFrame:
    """Mean and deviation of every fold metric for several models."""
    df, parts = materialise(df, "compare", spread=True), []
    ready = fold_preprocessing(df, models, roles, numeric, categorical)
    for model in models:
        folds = fold_metrics(out_of_fold(df, model, roles, key, numeric, categorical, ready=ready), model.task)
        parts.append(folds.withColumn("model", F.lit(model.name)))
    return metrics.fold_summary(reduce(lambda a, b: a.unionByName(b), parts), ["model"])


def stacked(df: DataFrame, models: list[Model], roles: list[FoldRole], key: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Out-of-fold scores of a logistic model fitted on the base models' out-of-fold scores.

    The second level uses the same folds; only rows every base model scored take part.
    """
    df, joined = materialise(df, "stack", spread=True), None
    for i, model in enumerate(models):
        oof = out_of_fold(df, model, roles, [key], numeric, categorical)
        part = oof.select(key, "fold", "label", F.col("score").alias(f"s{i}")) if joined is None else oof.select(key, F.col("score").alias(f"s{i}"))
        joined = part if joined is None else joined.join(part, key)
    meta = Model("stack", "logistic", params={"regParam": 0.001}, scale=True)
    names = [f"s{i}" for i in range(len(models))]
    folds = [r.fold for r in roles]
    second = [FoldRole(k, F.col("fold") != k, F.col("fold") == k) for k in folds]
    return out_of_fold(materialise(joined, "stack-level-2", spread=True), meta, second, [key, *names], names, [])


# ----------------------------------------------------------------------------------------------
# Final model
# ----------------------------------------------------------------------------------------------
def refit_and_save(df: DataFrame, model: Model, numeric: list[str], categorical: list[str], path: str, metadata: dict | None = None) -> PipelineModel:
    """Fit on all rows and store the pipeline next to its contract."""
    features = [*numeric, *categorical]
    if not features or len(set(features)) != len(features):
        raise ValueError("a model needs features, each named once")
    if "label" in features:
        raise ValueError("the target is among the features")
    fitted = fit(model, prepare(df, numeric), numeric, categorical)
    fitted.write().overwrite().save(f"{path}/model")
    contract = {"features": features, "numeric": numeric, "categorical": categorical, "task": model.task, "model": model.name, "metadata": metadata or {}}
    tables.write_contract(df.sparkSession, contract, f"{path}/contract")
    return fitted


def score_batch(df: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """Scores of new rows by a stored model, after checking them against its contract."""
    contract = tables.read_contract(df.sparkSession, f"{path}/contract")
    tables.check_contract(df, contract["features"], strict=False)
    rows = prepare(df.select(*keep, *[c for c in contract["features"] if c not in keep]), contract["numeric"])
    return predict(PipelineModel.load(f"{path}/model"), rows, contract["task"], keep)


def holdout_once(
    train: DataFrame, holdout: DataFrame, model: Model, roles: list[FoldRole], key: list[str], numeric: list[str], categorical: list[str], path: str,
) -> DataFrame:
    """Threshold from training out-of-fold scores, refit, one scoring of the hold-out, realised cost, drift."""
    train = materialise(train, "holdout-train", spread=True)
    oof = materialise(out_of_fold(train, model, roles, key, numeric, categorical), "holdout-oof")
    best = metrics.optimal_threshold(oof, "label", "score").first()
    refit_and_save(train, model, numeric, categorical, path, {"optimal_threshold": best["threshold"]})
    scored = materialise(score_batch(holdout, path, [*key, "label"]), "holdout-scores")
    flagged = F.col("score") >= best["threshold"]
    cost = F.when(~flagged & (F.col("label") == 1), best["cost_false_negative"]).when(flagged & (F.col("label") == 0), best["cost_false_positive"]).otherwise(0.0)
    realised = scored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(flagged).alias("n_flagged"), F.sum(cost).alias("realised_cost"), (F.sum(cost) / F.count(F.lit(1))).alias("cost_per_row"))
    drift = metrics.population_stability(oof, scored, "score")
    ranked = metrics.ranking_metrics(scored, "label", "score")
    out = with_scalars(with_scalars(realised, drift), ranked)
    return out.withColumn("threshold", F.lit(float(best["threshold"])))


# ----------------------------------------------------------------------------------------------
# Search, importance, selection
# ----------------------------------------------------------------------------------------------
def random_grid(space: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """Distinct parameter sets drawn with a fixed seed."""
    rng, out, seen = random.Random(seed), [], set()
    size = reduce(lambda a, b: a * len(b), space.values(), 1)
    while len(out) < min(n, size):
        pick = {k: rng.choice(v) for k, v in sorted(space.items())}
        if (mark := tuple(pick.items())) not in seen:
            seen.add(mark)
            out.append(pick)
    return out


def parameter_search(
    df: DataFrame, base: Model, space: dict[str, list], n: int, roles: list[FoldRole], key: list[str], numeric: list[str], categorical: list[str],
    metric: str = "roc_auc",
) -> DataFrame:
    """Mean out-of-fold metric of each parameter set, best first."""
    df, parts = materialise(df, "search", spread=True), []
    for i, params in enumerate(random_grid(space, n)):
        model = Model(f"trial_{i}", base.kind, base.task, {**base.params, **params}, base.scale, base.balanced)
        folds = fold_metrics(out_of_fold(df, model, roles, key, numeric, categorical), base.task).filter(F.col("metric") == metric)
        parts.append(folds.agg(F.lit(i).alias("trial"), F.lit(str(params)).alias("params"), F.avg("value").alias("value")))
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(F.col("value").desc(), "trial")


def shuffled_partner(df: DataFrame, key: str, columns: list[str], repeats: int, seed: int = 42) -> DataFrame:
    """Each row once per repeat, with the columns of another row dealt at random as ``<column>__p``.

    Rows are numbered by key and again by a hash; joining the numbers deals every row's values out
    exactly once per repeat.
    """
    home = row_position(df.select(key), [key], "_at")
    dealt = None
    for r in range(1, repeats + 1):
        source = df.select(F.col(key).alias("_k"), *[F.col(c).alias(f"{c}__p") for c in columns]).withColumn("_u", uniform("_k", r, seed))
        part = row_position(source, ["_u", "_k"], "_at").drop("_u", "_k").join(home, "_at").drop("_at").withColumn("repeat", F.lit(r))
        dealt = part if dealt is None else dealt.unionByName(part)
    return df.join(dealt, key)


def ranked_once(scored: DataFrame, by: list[str]) -> DataFrame:
    """Ranking metrics of scores that a model still has to give: it gives each once, and the passes read written counts."""
    counts = metrics.score_counts(metrics.pairs(scored, "label", "score", *by), by)
    return metrics.ranked_counts(materialise(counts, "ranked-scores"), by)


def permutation_importance(df: DataFrame, fitted, key: str, features: list[str], repeats: int = 5, seed: int = 42) -> DataFrame:
    """Mean and deviation of the AUC a model loses when one feature is dealt out at random.

    One shuffle of rows per repeat serves all features.
    """
    base = ranked_once(predict(fitted, df, "binary", [key, "label"]), []).select(F.col("roc_auc").alias("_base"))
    dealt = materialise(shuffled_partner(df, key, features, repeats, seed), "importance")
    scored = None
    for f in features:
        part = predict(fitted, dealt.withColumn(f, F.col(f"{f}__p")), "binary", ["repeat", "label"]).withColumn("feature", F.lit(f))
        scored = part if scored is None else scored.unionByName(part)
    auc = ranked_once(scored, ["feature", "repeat"])
    drops = with_scalars(auc, base).withColumn("drop", F.col("_base") - F.col("roc_auc"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance_mean"), F.stddev_samp("drop").alias("importance_std"))


def null_importance(df: DataFrame, key: str, features: list[str], runs: int = 25, percentile: float = 0.95, seed: int = 42, task: str = "binary") -> DataFrame:
    """Forest importance of each feature against its own distribution under shuffled labels."""
    model = Model("selector", "forest", task, {"numTrees": 10, "maxDepth": 4, "seed": 42})
    rows = materialise(prepare(df.select(key, "label", *features), features), "selection", spread=True)
    dealt = shuffled_partner(rows, key, ["label"], runs, seed).withColumn("label", F.col("label__p"))
    dealt = materialise(dealt, "selection-dealt", spread=True)

    def importances(train: DataFrame) -> list[float]:
        return [float(x) for x in fit(model, train, features, []).stages[-1].featureImportances.toArray()]

    fits = in_parallel([lambda: importances(rows)] + [lambda r=r: importances(dealt.filter(F.col("repeat") == r)) for r in range(1, runs + 1)])
    long = [(f, run, v) for run, values in enumerate(fits) for f, v in zip(features, values)]
    table = df.sparkSession.createDataFrame(long, "feature string, run int, importance double")  # features x runs numbers
    out = table.groupBy("feature").agg(
        F.max(F.when(F.col("run") == 0, F.col("importance"))).alias("actual_importance"),
        F.avg(F.when(F.col("run") > 0, F.col("importance"))).alias("null_mean"),
        F.percentile(F.when(F.col("run") > 0, F.col("importance")), percentile).alias("null_cut"))
    return out.withColumn("gain_over_null", F.col("actual_importance") - F.col("null_cut")).withColumn("kept", F.col("gain_over_null") > 0)


def select_features(
    df: DataFrame, key: str, numeric: list[str], categorical: list[str], runs: int = 25, threshold: float = 0.95, priority: set[str] = frozenset(),
) -> DataFrame:
    """Variance, then redundancy, then null importance; the cheap filters spare the costly one columns.

    Give it the training rows of a fold only.
    """
    spark, status = df.sparkSession, {}
    for r in encode.variance_filter(df, [*numeric, *categorical]).collect():  # one row per column
        if r["verdict"] != "kept":
            status[r["column"]] = r["verdict"]
    left = [c for c in numeric if c not in status]
    for column, other in encode.correlation_filter(df, left, threshold, priority).items():
        status[column] = f"correlated with {other}"
    left = [c for c in left if c not in status]
    for r in null_importance(df, key, left, runs).collect():
        if not r["kept"]:
            status[r["feature"]] = "null importance"
    rows = [(c, "dropped" if c in status else "kept", status.get(c, "")) for c in [*numeric, *categorical]]
    return spark.createDataFrame(rows, "feature string, status string, reason string")


# ----------------------------------------------------------------------------------------------
# Attribution
# ----------------------------------------------------------------------------------------------
def linear_contributions(df: DataFrame, key: str, coefficients: dict[str, float], centre: dict[str, float], spread: dict[str, float], top: int = 8) -> DataFrame:
    """Largest contributions coefficient x scaled feature per row, ranked, without a shuffle."""
    entries = []
    for f, b in coefficients.items():
        part = F.lit(b) * (F.col(f) - F.lit(centre[f])) / F.lit(spread[f])
        entries.append(F.struct((-F.abs(part)).alias("order"), F.lit(f).alias("feature"), part.alias("contribution")))
    best = F.slice(F.array_sort(F.array(*entries)), 1, top)
    long = df.select(key, F.posexplode(best).alias("_pos", "_entry"))
    direction = F.when(F.col("_entry.contribution") > 0, "increases risk").otherwise("reduces risk")
    return long.select(key, (F.col("_pos") + 1).alias("rank"), "_entry.feature", "_entry.contribution", direction.alias("direction"))


def importance_stack(importances: DataFrame, top: int = 10) -> DataFrame:
    """The most important features of every module side by side."""
    rank = F.row_number().over(Window.partitionBy("module").orderBy(F.col("importance").desc(), "feature"))
    return importances.withColumn("rank", rank).filter(F.col("rank") <= top)
