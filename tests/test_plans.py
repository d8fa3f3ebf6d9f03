"""Shape of physical plans: shuffles, pushed filters, pruned columns."""
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import audit, features, metrics, money, portfolio
from ledgerline.operators import ordered as o
from ledgerline.plans.views import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range)partitioning|Exchange SinglePartition", plan(df)))


def test_transaction_features_shuffle_once_per_entity(t):
    assert shuffles(features.transaction_features(t.transactions)) == 2


def test_panel_features_shuffle_by_entity_then_by_day(t):
    base = t.market.limit(0)  # the panel itself is an aggregate with its own shuffles
    assert shuffles(features.panel_features(base)) - shuffles(base) <= 2


def test_tape_features_shuffle_once(t):
    assert shuffles(features.tape_features(t.tape)) == 1


def test_row_wise_features_do_not_shuffle(t):
    for df in (features.option_features(t.options), money.value_options(t.options), money.option_greeks(t.options), features.appraisal_features(t.initiatives)):
        assert shuffles(df) == 0


def test_filters_and_columns_reach_the_scan(t):
    df = metrics.probability_metrics(t.events.filter("user_id = 3").withColumn("p", F.lit(0.4)).withColumn("y", (F.col("value") > 50).cast("int")), "y", "p")
    text = plan(df)
    assert "EqualTo(user_id,3)" in text
    assert re.search(r"ReadSchema: struct<user_id:bigint,value:double>", text)


def test_profiles_aggregate_before_they_shuffle(t):
    text = plan(audit.value_counts(t.part, ["p_brand", "p_type"]))
    assert text.index("partial_count") > text.index("Exchange hashpartitioning")  # printed top-down: partial below the exchange


def test_no_python_workers_outside_mean_variance(t):
    for df in (
        features.transaction_features(t.transactions), metrics.ranking_metrics(t.scored, "label", "score"),
        metrics.cost_curve(t.scored, "label", "score"), portfolio.historical_risk(t.book_returns, ["book"], "ret"),
        o.average_ranks(t.customers, [], {"r": "Estimated_CLV"}),
    ):
        assert "Python" not in plan(df) and "Pandas" not in plan(df)
