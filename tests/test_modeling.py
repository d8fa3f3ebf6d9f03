"""Fits never see the rows they score; contracts, importance and selection behave."""
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import metrics, modeling as ml, splits
from ledgerline.session import fresh_dir
from ledgerline.sources import tables

NUMERIC = ["signal", "noise", "other"]
LOGISTIC = ml.Model("logistic", "logistic", params={"regParam": 0.01, "maxIter": 20}, scale=True)


@pytest.fixture(scope="module")
def toy(spark):
    rng = random.Random(21)
    rows = []
    for i in range(900):
        x = rng.gauss(0, 1)
        rows.append((i, float(rng.random() < 1 / (1 + 2.718281828 ** (-2 * x))), None if i % 50 == 0 else x, rng.gauss(0, 1), rng.gauss(0, 1), "ab"[i % 2]))
    df = spark.createDataFrame(rows, "id long, label double, signal double, noise double, other double, kind string")
    folds = splits.stratified_folds(df, "id", "label", 3).select("id", "fold")
    return df.join(folds, "id").cache()


def test_every_row_is_scored_once_and_the_signal_is_found(toy):
    seen = []
    oof = ml.out_of_fold(toy, LOGISTIC, ml.kfold_roles("fold", 3), ["id"], NUMERIC, ["kind"], on_fold=lambda k, d: seen.append(k))
    assert oof.count() == 900 and oof.select("id").distinct().count() == 900 and sorted(seen) == [1, 2, 3]
    assert metrics.ranking_metrics(oof, "label", "score").first().roc_auc > 0.8


def test_trivial_baseline_scores_the_training_rate(toy):
    oof = ml.out_of_fold(toy, ml.BASELINES["binary"][0], ml.kfold_roles("fold", 3), ["id"], NUMERIC, [])
    want = toy.filter("fold <> 2").agg(F.avg("label")).first()[0]
    assert oof.filter("fold = 2").select("score").distinct().collect()[0][0] == pytest.approx(want)


def test_saved_model_keeps_its_contract(spark, toy):
    path = fresh_dir(spark, "toy-model")
    fitted = ml.refit_and_save(toy, LOGISTIC, NUMERIC, ["kind"], path, {"optimal_threshold": 0.2})
    assert tables.read_contract(spark, f"{path}/contract")["metadata"] == {"optimal_threshold": 0.2}
    again = ml.score_batch(toy.drop("label"), path, ["id"])
    direct = ml.predict(fitted, ml.prepare(toy, NUMERIC), "binary", ["id"]).withColumnRenamed("score", "d")
    assert again.join(direct, "id").filter("abs(score - d) > 1e-12").count() == 0
    unseen = toy.limit(5).withColumn("kind", F.lit("never seen"))
    assert ml.score_batch(unseen, path, ["id"]).filter("score IS NULL").count() == 0
    with pytest.raises(ValueError, match="missing"):
        ml.score_batch(toy.drop("noise"), path, ["id"])
    for numeric, categorical in (([], []), (["noise", "noise"], []), (["label"], [])):
        with pytest.raises(ValueError):
            ml.refit_and_save(toy, LOGISTIC, numeric, categorical, path)


def test_dealt_values_are_a_permutation(toy):
    dealt = ml.shuffled_partner(toy.select("id", "noise"), "id", ["noise"], 2)
    for r in (1, 2):
        part = dealt.filter(F.col("repeat") == r)
        assert part.count() == 900
        assert sorted(x[0] for x in part.select("noise__p").collect()) == sorted(x[0] for x in part.select("noise").collect())
        assert part.filter("noise <> noise__p").count() > 800


def test_importance_and_selection_prefer_the_signal(toy):
    fitted = ml.fit(LOGISTIC, ml.prepare(toy.filter("fold <> 1"), NUMERIC), NUMERIC, [])
    drop = {r.feature: r.importance_mean for r in ml.permutation_importance(ml.prepare(toy.filter("fold = 1"), NUMERIC), fitted, "id", NUMERIC, 2).collect()}
    assert drop["signal"] > 0.1 > max(abs(drop["noise"]), abs(drop["other"])) * 2
    df = toy.withColumn("constant", F.lit(2.0)).withColumn("copy", F.col("signal") * 3)
    verdict = {r.feature: (r.status, r.reason) for r in ml.select_features(df, "id", ["signal", "copy", "noise", "constant"], [], runs=4, priority={"signal"}).collect()}
    assert verdict["signal"][0] == "kept" and verdict["constant"] == ("dropped", "variance") and verdict["copy"] == ("dropped", "correlated with signal")


def test_importance_reads_written_scores(toy):
    fitted = ml.fit(LOGISTIC, ml.prepare(toy.filter("fold <> 1"), NUMERIC), NUMERIC, [])
    out = ml.permutation_importance(ml.prepare(toy.filter("fold = 1"), NUMERIC), fitted, "id", NUMERIC, 2)
    assert "UDF" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_models_of_a_comparison_share_preprocessing(toy, monkeypatch):
    built, plain = [], ml.preprocessing
    monkeypatch.setattr(ml, "preprocessing", lambda *a: built.append(a) or plain(*a))
    forest = ml.Model("forest", "forest", params={"numTrees": 3, "maxDepth": 2})
    balanced = ml.Model("balanced", "logistic", params={"regParam": 0.01, "maxIter": 20}, scale=True, balanced=True)
    models, roles = [ml.BASELINES["binary"][0], LOGISTIC, forest, balanced], ml.kfold_roles("fold", 3)
    assert ml.compare(toy, models, roles, ["id"], NUMERIC, ["kind"]).select("model").distinct().count() == 4 and len(built) == 3
    ready = ml.fold_preprocessing(toy, models, roles, NUMERIC, ["kind"])
    for model in models[1:]:
        alone = ml.out_of_fold(toy, model, roles, ["id"], NUMERIC, ["kind"])
        shared = ml.out_of_fold(toy, model, roles, ["id"], NUMERIC, ["kind"], ready=ready).withColumnRenamed("score", "s")
        assert alone.join(shared, ["id", "fold"]).filter("abs(score - s) < 1e-9").count() == 900


def test_class_weights_do_not_deal_rows_by_class(toy):
    weighted = ml.balanced_weights(toy, "label")
    assert "rightHint=(strategy=broadcast)" in weighted._jdf.queryExecution().optimizedPlan().toString()
    sums = {r[0]: r[1] for r in weighted.groupBy("label").agg(F.sum("_weight")).collect()}
    assert sums == pytest.approx({0.0: 450.0, 1.0: 450.0})


def test_grid_is_seeded_and_distinct():
    space = {"a": [1, 2, 3], "b": [0.1, 0.2]}
    grid = ml.random_grid(space, 10)
    assert len(grid) == 6 and grid == ml.random_grid(space, 10) and len({tuple(g.items()) for g in grid}) == 6
    with pytest.raises(ValueError):
        ml.Model("x", "boosted", "multiclass").estimator()
