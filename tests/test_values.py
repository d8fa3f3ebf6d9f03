"""Results that can be worked out by hand, and properties that must hold."""
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import bands, normal, scalar
from ledgerline.operators import allocation, audit, encode, features, metrics, money, portfolio, splits
from ledgerline.sources import specs, tables


def one(df):
    return df.collect()[0]


def scores(spark, labels, values):
    return spark.createDataFrame([(i, float(y), float(s)) for i, (y, s) in enumerate(zip(labels, values))], "id long, y double, s double")


# ------------------------------------------------------------------------------------ metrics
def test_four_row_reference(spark):
    df = scores(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    rank, prob = one(metrics.ranking_metrics(df, "y", "s")), one(metrics.probability_metrics(df, "y", "s"))
    assert rank.roc_auc == pytest.approx(0.75)
    assert rank.pr_auc == pytest.approx(0.8333333)
    assert rank.ks == pytest.approx(0.5)
    assert prob.brier == pytest.approx(0.158125)


@pytest.mark.parametrize("values, auc", [([0.1, 0.2, 0.8, 0.9], 1.0), ([0.9, 0.8, 0.2, 0.1], 0.0), ([0.5] * 4, 0.5)])
def test_auc_extremes_and_ties(spark, values, auc):
    assert one(metrics.ranking_metrics(scores(spark, [0, 0, 1, 1], values), "y", "s")).roc_auc == pytest.approx(auc)


def test_one_class_has_no_auc(spark):
    assert one(metrics.ranking_metrics(scores(spark, [1, 1], [0.2, 0.4]), "y", "s")).roc_auc is None


def test_ties_match_pair_counting(spark, split_small):
    rng = random.Random(3)
    rows = [(rng.random() < 0.3, rng.randrange(11) / 10) for _ in range(600)]
    df = scores(spark, [r[0] for r in rows], [r[1] for r in rows])
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert one(metrics.ranking_metrics(df, "y", "s")).roc_auc == pytest.approx(pairs / len(pos) / len(neg))


def test_gains_capture_everything_and_lift_starts_high(spark):
    rng = random.Random(5)
    rows = [(1 if rng.random() < s else 0, s) for s in (round(rng.random(), 2) for _ in range(503))]
    table = metrics.gains_table(scores(spark, [r[0] for r in rows], [r[1] for r in rows]), "y", "s", "id").orderBy("decile").collect()
    assert [r.n for r in table] == [51] * 3 + [50] * 7
    assert table[-1].cumulative_capture == pytest.approx(1.0) and table[-1].cumulative_lift == pytest.approx(1.0)
    assert table[0].lift > table[-1].lift


def test_lift_share_is_checked(spark):
    with pytest.raises(ValueError):
        metrics.lift_at(scores(spark, [0, 1], [0.1, 0.2]), "y", "s", "id", [0.0])


def test_cost_optimum_beats_both_baselines(spark):
    rng = random.Random(11)
    rows = [(int(rng.random() < 0.05), 0.0) for _ in range(800)]
    rows = [(y, round(min(1.0, max(0.0, rng.gauss(0.6 if y else 0.3, 0.15))), 4)) for y, _ in rows]
    df = scores(spark, [r[0] for r in rows], [r[1] for r in rows])
    best = one(metrics.optimal_threshold(df, "y", "s"))
    brute = min(
        (sum(10000 for y, s in rows if y and s < i * 0.002) + sum(500 for y, s in rows if not y and s >= i * 0.002), i) for i in range(501))
    assert best.total_cost == pytest.approx(brute[0]) and best.threshold == pytest.approx(brute[1] * 0.002)
    assert best.total_cost <= min(best.cost_flag_nothing, best.cost_flag_everything)
    curve = metrics.cost_curve(df, "y", "s")
    assert curve.count() == 501 and curve.filter("threshold = 1.0").count() == 1


def test_missing_scores_are_left_out(spark):
    df = spark.createDataFrame([(1.0, 0.9), (0.0, 0.1), (1.0, None), (None, 0.4), (0.0, float("nan"))], "y double, s double")
    assert one(metrics.probability_metrics(df, "y", "s")).n == 2


def test_kupiec_accepts_the_expected_share_and_rejects_many(spark):
    df = spark.createDataFrame([(10, 1000), (40, 1000), (0, 1000), (0, 0)], "x long, n long")
    rows = df.withColumns(metrics.kupiec("x", "n", 0.99)).collect()
    assert rows[0].lr_statistic == pytest.approx(0.0, abs=1e-9) and rows[0].p_value == pytest.approx(1.0)
    assert rows[1].p_value < 1e-6
    assert rows[2].lr_statistic == pytest.approx(-2 * 1000 * math.log(0.99))
    assert rows[3].lr_statistic is None


def test_rank_ic_of_perfect_order_is_one(spark):
    df = spark.createDataFrame([(d, float(i), float(i * i)) for d in range(6) for i in range(5)] + [(9, 1.0, 1.0)], "d int, y double, p double")
    row = one(metrics.rank_ic(df, "y", "p", "d"))
    assert row.mean_ic == pytest.approx(1.0) and row.n_dates == 6 and row.hit_rate == 1.0


def test_stability_index_is_zero_for_the_same_population_and_grows_with_shift(spark):
    df = spark.range(500).select((F.col("id") % 97).cast("double").alias("v"))
    same = one(metrics.population_stability(df, df, "v")).psi
    moved = one(metrics.population_stability(df, df.withColumn("v", F.col("v") + 40), "v")).psi
    assert same == pytest.approx(0.0, abs=1e-12) and moved > 0.25
    flat = df.withColumn("v", F.lit(1.0))
    assert one(metrics.population_stability(flat, flat, "v")).psi is None


def test_bootstrap_covers_the_point_and_repeats(spark):
    rng = random.Random(2)
    ys = [int(rng.random() < 0.3) for _ in range(400)]
    df = scores(spark, ys, [rng.gauss(y, 1) for y in ys])
    a, b = one(metrics.bootstrap_auc(df, "y", "s", "id", 40)), one(metrics.bootstrap_auc(df.repartition(7), "y", "s", "id", 40))
    assert a.lower < a.point < a.upper
    assert a.asDict() == pytest.approx(b.asDict())


# -------------------------------------------------------------------------------------- money
def test_rate_at_an_exact_middle(spark):
    """One flow of 5.505 for 1: the first middle of the interval is the root itself."""
    df = spark.createDataFrame([(5.505, 0.0, 0.0, 1.0), (1.5, 0.0, 0.0, 1.0)], "a double, b double, c double, i double")
    assert [r[0] for r in df.select(money.irr(["a", "b", "c"], "i")).collect()] == pytest.approx([4.505, 0.5])


def test_bounds_that_cannot_be_met_stop_the_job(spark):
    good = [("p", "x", 0.05, 0.1, 0.2, 0.8, 0.0), ("p", "y", 0.03, 0.05, 0.2, 0.8, 0.0)]
    columns = "portfolio string, bucket string, net_return double, volatility double, low double, high double, loss_rate double"
    assert allocation.allocate(spark.createDataFrame(good, columns), "portfolio", [2.0]).count() == 2
    for low, high in ((0.7, 0.8), (0.1, 0.4)):
        bad = [("q", *g[1:4], low, high, 0.0) for g in good]
        with pytest.raises(Exception, match="portfolio q"):
            allocation.allocate(spark.createDataFrame(good + bad, columns), "portfolio", [2.0]).collect()


def test_identity_among_many_columns_and_twelve_classes(spark):
    rng = random.Random(31)
    rows = [tuple(rng.gauss(0, 1) for _ in range(24)) for _ in range(300)]
    df = spark.createDataFrame([(*r, r[3] - r[7]) for r in rows], [f"c{i}" for i in range(25)])
    hit = one(audit.identity_scan(df))
    assert (hit.subject, hit.left_operand, hit.operator, hit.right_operand) == ("c3", "c7", "+", "c24")
    classes = spark.createDataFrame([(f"k{i % 12:02d}", float(i % 12) + rng.random() / 2, rng.random()) for i in range(1200)], "y string, x double, n double")
    got = {r.column: r.agreement for r in audit.label_reconstruction(classes, "y", ["x", "n"]).collect()}
    assert got["x"] > 0.99 and got["n"] < 0.3


def test_every_class_has_a_weight(spark):
    from ledgerline.operators import modeling

    df = spark.range(6000).select((F.col("id") % 2000).cast("double").alias("label")).unionByName(spark.createDataFrame([(None,)], "label double"))
    weighted = modeling.balanced_weights(df, "label")
    assert weighted.filter("label IS NOT NULL AND abs(_weight - 1) > 1e-9").count() == 0 and weighted.filter("_weight IS NULL").count() == 1


def test_project_values(spark):
    df = spark.createDataFrame([(100.0, 100.0, 100.0, 250.0), (1.0, 1.0, 1.0, 1e6)], "a double, b double, c double, i double")
    rows = df.select(money.npv(["a", "b", "c"], 0.10, "i").alias("npv"), money.irr(["a", "b", "c"], "i").alias("irr")).collect()
    assert rows[0].npv == pytest.approx(-1.3148, abs=1e-3)
    assert 0.09 < rows[0].irr < 0.10
    assert sum(100 / (1 + rows[0].irr) ** t for t in (1, 2, 3)) == pytest.approx(250, abs=1e-6)
    assert rows[1].irr is None


@pytest.mark.parametrize("rating, bar", [("medium", specs.FUND_THRESHOLD), ("High", specs.FUND_THRESHOLD + specs.HIGH_RISK_PENALTY)])
def test_funding_changes_at_its_bars_and_only_there(spark, rating, bar):
    """Along rising values the decision is Reject, Review, Fund, and changes exactly at the two bars."""
    steps = [bar + k * 0.375 for k in range(-60, 40)] + [specs.REVIEW_BAND[0], bar]
    got = {r.v: r.d for r in spark.createDataFrame([(v, rating) for v in steps], "v double, r string").select("v", money.fund_decision("v", "r").alias("d")).collect()}
    for v, d in got.items():
        assert d == ("Fund" if v > bar else "Review" if v >= specs.REVIEW_BAND[0] else "Reject"), v


def test_credit_never_gets_easier_with_risk(spark):
    """Over a grid, a higher default probability or loss ratio never improves a decision, and cover never worsens it."""
    grid = [(p / 40, e * 0.03, c / 2) for p in range(17) for e in range(11) for c in range(5)]
    df = spark.createDataFrame(grid, "p double, ratio double, cover double").withColumn("x", F.lit(800.0)).withColumn("e", F.col("ratio") * 800.0)
    rows = df.select("p", "ratio", "cover", money.credit_decision("p", "e", "x").alias("plain"), money.credit_decision("p", "e", "x", "cover").alias("secured")).collect()
    rank = {"Approve": 0, "Review": 1, "Reject": 2}
    at = {(round(r.p * 40), round(r.ratio / 0.03), r.cover): r for r in rows}
    for (p, e, c), r in at.items():
        assert rank[r.secured] <= rank[r.plain]
        assert r.secured == r.plain or (r.plain == "Review" and r.cover >= specs.UPGRADE_COVERAGE)
        for worse in ((p + 1, e, c), (p, e + 1, c)):
            if worse in at:
                assert rank[at[worse].plain] >= rank[r.plain]
    assert {r.plain for r in rows} == set(rank) and any(r.secured != r.plain for r in rows)
    unknown = spark.createDataFrame([(0.1, 40.0, 0.0)], "p double, e double, x double").select(money.credit_decision("p", "e", "x"))
    assert one(unknown)[0] == "Review"


def test_bands_are_closed_on_the_left(spark):
    edges = specs.PD_BAND_EDGES
    points = [x for e in edges[1:] for x in (e - 1e-6, e)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in points], "p double").select(money.risk_band("p")).collect()]
    names = [*specs.PD_BAND_LABELS, specs.PD_BAND_DEFAULT]
    assert got == [n for k in range(len(edges) - 1) for n in names[k : k + 2]]


def test_option_reference_point(spark):
    schema = "Spot double, Strike double, Time_to_Maturity double, Volatility double, Interest_Rate double, Option_Type string, Black_Scholes_Price double, Market_Price double"
    df = spark.createDataFrame([(100.0, 100.0, 1.0, 0.2, 0.05, k, 1.0, 1.0) for k in ("Call", "Put")], schema)
    call, put = money.option_greeks(money.value_options(df)).collect()
    assert call.bs_recomputed == pytest.approx(10.4506, abs=1e-4) and put.bs_recomputed == pytest.approx(5.5735, abs=1e-4)
    assert call.delta == pytest.approx(0.6368, abs=1e-4) and call.gamma == pytest.approx(0.01876, abs=1e-5)
    assert call.vega == pytest.approx(0.3752, abs=1e-4) and call.rho == pytest.approx(0.5323, abs=1e-4)
    assert call.delta - put.delta == pytest.approx(1.0) and call.gamma == pytest.approx(put.gamma)
    parity = call.bs_recomputed - put.bs_recomputed
    assert parity == pytest.approx(100 - 100 * math.exp(-0.05))


def test_normal_functions(spark):
    rows = spark.range(-400, 401).select((F.col("id") / 50).alias("x")).select("x", normal.norm_cdf("x").alias("c"), normal.erfc(F.abs("x")).alias("e")).collect()
    for r in rows:
        assert r.c == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-7)
        assert r.e == pytest.approx(math.erfc(abs(r.x)), rel=1e-7)


def test_stress_hits_harder_when_severe(spark):
    df = spark.createDataFrame([(50000.0, 500.0, 13000.0, 3000.0)], "deposits double, wholesale_funding double, liquid_assets double, expected_outflows double")
    rows = {r.scenario: r for r in money.stress_liquidity(df).collect()}
    assert rows["extreme"].coverage_ratio < rows["severe"].coverage_ratio < rows["mild"].coverage_ratio
    assert rows["mild"].stressed_outflows == pytest.approx(3000 + 1000 + 50)


def test_contact_list_ranks_every_customer_once(spark, split_small):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 7).cast("double").alias("clv"), (F.col("id") % 3 / 3.0).alias("p"))
    rows = money.prioritise(df, "clv", "p", "id", budget=30).collect()
    assert sorted(r.contact_rank for r in rows) == list(range(1, 201)) and sum(r.contact for r in rows) == 30


# --------------------------------------------------------------------------------- portfolios
def test_constant_return_series(spark):
    import datetime as dt

    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), 0.01) for i in range(252)]
    row = one(portfolio.portfolio_metrics(spark.createDataFrame(rows, "b string, d date, r double"), ["b"], "d", "r"))
    assert row.total_return == pytest.approx(1.01**252 - 1) and row.annual_return == pytest.approx(1.01**252 - 1)
    assert row.max_drawdown == pytest.approx(0.0, abs=1e-12) and row.hit_rate == 1.0 and row.calmar is None


def _panel(spark, days=260, entities=5):
    import datetime as dt

    rng = random.Random(9)
    dates = [dt.date(2023, 1, 2) + dt.timedelta(days=i) for i in range(days)]
    rows = [(d, f"e{k}", rng.gauss(0.0005, 0.01), rng.gauss(0, 1)) for d in dates for k in range(entities)]
    return spark.createDataFrame(rows, "d date, e string, r double, s double"), rows, dates


def test_backtest_against_a_loop(spark):
    df, rows, dates = _panel(spark)
    cal = portfolio.calendar(df, "d")
    reb = portfolio.rebalance_calendar(cal, "d", 60)
    weights = portfolio.signal_weights(df.select("d", "e", "s"), reb, "d", "e", "s", short_q=0.2)
    got = {r.d: r for r in portfolio.backtest(df, weights, "d", "e", "r").collect()}
    by_day = {d: {} for d in dates}
    for d, e, r, s in rows:
        by_day[d][e] = (r, s)
    months = {}
    for i, d in enumerate(dates):
        months[d.year, d.month] = (i, d)
    days = {d for i, d in months.values() if i >= 60}
    held = {f"e{k}": 0.2 for k in range(5)}
    for d in dates:
        cost = 0.0
        if d in days:
            ranked = sorted(by_day[d], key=lambda e: by_day[d][e][1])
            new = dict.fromkeys(held, 0.0) | {ranked[-1]: 0.5, ranked[-2]: 0.5} | {ranked[0]: -1.0}
            cost = sum(abs(new[e] - held[e]) for e in held) * 10 / 10000
            held = new
        want = sum(held[e] * by_day[d][e][0] for e in held) - cost
        assert got[d].portfolio_return == pytest.approx(want, abs=1e-12), d
    lagged = portfolio.backtest(df, weights, "d", "e", "r", execution_lag=1).filter("turnover > 0").select("d").collect()
    assert {r.d for r in lagged} == {dates[dates.index(d) + 1] for d in days if dates.index(d) + 1 < len(dates)}


def test_mean_variance_weights_are_a_portfolio(spark):
    df, _, _ = _panel(spark)
    cal = portfolio.calendar(df, "d")
    w = portfolio.mean_variance_weights(df, portfolio.rebalance_calendar(cal, "d"), cal, "d", "e", "r").cache()
    sums = w.groupBy("d").agg(F.sum("weight").alias("t"), F.min("weight").alias("lo"), F.count(F.lit(1)).alias("n")).collect()
    assert sums and all(r.t == pytest.approx(1.0) and r.lo >= 0 and r.n == 5 for r in sums)


def test_shortfall_is_worse_than_value_at_risk(spark):
    df, _, _ = _panel(spark)
    for r in portfolio.historical_risk(df, ["e"], "r", 0.95).collect():
        assert r.expected_shortfall >= r["var"] > 0


def test_allocation_is_optimal_and_within_bounds(spark):
    inputs = allocation.bucket_inputs(spark.createDataFrame([("retail_lending", 0.2)], "bucket string, expected_return double"))
    rows = allocation.allocate(inputs, None, [2.0], ceiling=None).collect()
    info = {r.bucket: r for r in inputs.collect()}
    assert sum(r.allocation_pct for r in rows) == pytest.approx(1.0)
    assert not info["retail_lending"].is_placeholder and info["equity_investments"].is_placeholder
    slope = lambda r: info[r.bucket].net_return - 2.0 * info[r.bucket].volatility ** 2 * r.allocation_pct
    room_up = [slope(r) for r in rows if r.allocation_pct < r.high - 1e-9]
    room_down = [slope(r) for r in rows if r.allocation_pct > r.low + 1e-9]
    assert max(room_up) <= min(room_down) + 1e-9  # no profitable shift is left
    for r in rows:
        assert r.low - 1e-9 <= r.allocation_pct <= r.high + 1e-9
    tight = allocation.allocate(inputs, None, [2.0], ceiling=0.03).collect()
    assert tight[0].effective_risk_aversion > 2.0 and tight[0].portfolio_risk <= 0.03


# -------------------------------------------------------------------------------------- leaks
def test_identity_is_told_about_the_preferred_column(spark):
    """Three relations among nine columns, one of them with missing parts; integers beside doubles."""
    rng = random.Random(41)
    rows = []
    for i in range(260):
        u, v, w, z = (rng.randrange(-900, 900) for _ in range(4))
        rows.append((i, u, v, u + v, float(w), None if i % 6 == 0 else float(z), float(w - z), v - w))
    df = spark.createDataFrame(rows, "row long, u long, v long, total long, w double, z double, rest double, mixed long")
    hits = {h.subject: (h.left_operand, h.operator, h.right_operand) for h in audit.identity_scan(df, {"row"}, {"rest", "mixed"}).collect()}
    assert hits == {"u": ("total", "-", "v"), "rest": ("w", "-", "z"), "mixed": ("v", "-", "w")}


def test_constants_and_aliases_are_measured_by_spread_and_correlation(spark):
    df = spark.range(500).select("id", (F.lit(5000.0) + F.col("id") % 7).alias("flat"), (F.col("id") % 97).cast("double").alias("wide"))
    assert [r.column for r in audit.near_constant(df, {"id"}).collect()] == ["flat"]
    df = df.withColumn("mirror", 12 - 0.5 * F.col("wide"))
    assert [r.column for r in audit.target_aliases(df, "mirror", {"id"}).collect()] == ["wide"]


def test_identity_that_fails_on_one_late_row_is_not_reported(spark):
    df = spark.range(3000).select((F.col("id") * 1.0).alias("a"), (F.col("id") * 2.0).alias("b"), F.when(F.col("id") == 2999, 0.0).otherwise(F.col("id") * 3.0).alias("c"))
    assert audit.identity_scan(df).count() == 0


def test_a_cut_of_unequal_classes_is_found_and_a_shuffled_one_is_not(spark):
    """Five classes of 1, 2, 3, 4 and 5 parts of a skewed amount, named in its order; a fifth of the amounts is missing."""
    rng = random.Random(44)
    amounts = sorted(rng.expovariate(0.2) for _ in range(1500))
    edges = [100, 300, 600, 1000, 1500]
    rows = [(None if k % 5 == 4 else x, next(f"c{i}" for i, e in enumerate(edges) if k < e), rng.random()) for k, x in enumerate(amounts)]
    got = {r.column: r.agreement for r in audit.label_reconstruction(spark.createDataFrame(rows, "x double, y string, n double"), "y", ["x", "n"]).collect()}
    assert got["x"] > 0.75 and got["n"] < 0.4


def test_undeclared_leak_stops_and_declared_one_does_not(spark):
    rng = random.Random(6)
    rows = [(i, y := rng.randrange(2), y * 3.0 + 1) for i in range(300)]
    df = spark.createDataFrame(rows, "Customer_ID long, Default_Flag int, echo double")
    spec = specs.TableSpec("loans", "binary_classification", "Default_Flag", id_columns=("Customer_ID",))
    with pytest.raises(ValueError, match="target_alias"):
        audit.raise_if_critical(audit.findings(df, spec))
    declared = specs.TableSpec("loans", "binary_classification", "Default_Flag", id_columns=("Customer_ID",), drop_always=("echo",))
    audit.raise_if_critical(audit.findings(df, declared))


def test_leaky_builder_is_caught_and_causal_one_passes(spark):
    df = spark.createDataFrame([(i, i, float((i * 37) % 101)) for i in range(200)], "id long, t long, x double")
    leaky = lambda d: d.withColumn("f", F.col("x") - d.agg(F.avg("x")).first()[0])
    honest = lambda d: features.causal(d, [], ["t"], {"f": features.rolling("x", 5, "mean")})
    bad = one(features.causality_proof(df, leaky, "id", "t", 160, ["x"], ["f"]))
    good = one(features.causality_proof(df, honest, "id", "t", 160, ["x"], ["f"]))
    assert bad.n_changed == 160 and not bad.is_causal
    assert good.n_changed == 0 and good.n_compared == 160


# ----------------------------------------------------------------------------------- encodings
def test_out_of_fold_encoding_does_not_see_its_own_rows(spark):
    df = spark.range(4000).select(
        "id", (F.col("id") % 400).cast("string").alias("c"), (scalar.uniform("id", 77) < 0.05).cast("int").alias("y"))  # noise
    df = df.withColumn("fold", encode.hashed_fold("id", 5, 1))
    oof = encode.out_of_fold_encode(df, "c", "y", "fold", "e")
    naive = encode.target_encode(df, df, "c", "y", "e", smoothing=0.0)
    corr = lambda d: abs(d.agg(F.corr("e", "y")).first()[0])
    assert corr(naive) > 0.2 and corr(oof) < 0.06 and oof.filter("e IS NULL").count() == 0


def test_unseen_category_gets_the_default(spark):
    train = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "c string, y int")
    new = spark.createDataFrame([("a",), ("z",)], "c string")
    freq = {r.c: r.f for r in encode.frequency_encode(new, train, "c", "f").collect()}
    rate = {r.c: r.m for r in encode.target_encode(new, train, "c", "y", "m", smoothing=10.0).collect()}
    assert freq == {"a": pytest.approx(2 / 3), "z": 0.0}
    assert rate["z"] == pytest.approx(2 / 3) and rate["a"] == pytest.approx((1 + 10 * 2 / 3) / 12)


def test_correlation_filter_keeps_the_preferred_member_of_a_chain(spark):
    df = spark.range(300).select((F.col("id") * 1.0).alias("x"), (F.col("id") * 2.0 + 1).alias("y"), (F.col("id") * -3.0).alias("z"), (F.crc32(F.col("id").cast("string")) * 1.0).alias("n"))
    assert set(encode.correlation_filter(df, ["x", "y", "z", "n"], priority={"y"})) == {"x", "z"}


def test_bands(spark):
    df = spark.createDataFrame([(0.0,), (580.0,), (580.1,), (901.0,), (None,)], "v double")
    got = [r[0] for r in df.select(bands.band("v", specs.CREDIT_BAND_EDGES, specs.CREDIT_BAND_LABELS)).collect()]
    assert got == [None, "poor", "fair", None, None]
    edges = [0.0, 1.0, 2.0]
    x = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0)], "v double")
    assert [r[0] for r in x.select(bands.bin_right_closed("v", [0.0, 0.5, 1.0, 2.0])).collect()] == [1, 2, 3, 3]
    assert [r[0] for r in x.select(bands.bin_left_closed("v", edges)).collect()] == [1, 2, 2, 2]


def test_safe_division(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (1e308, 1e-10), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(scalar.safe_div("a", "b")).collect()] == [None, 0.5, None, None]


# -------------------------------------------------------------------------------------- splits
def test_purged_folds_keep_dates_whole_and_leave_a_gap(spark):
    df, _, dates = _panel(spark, 200, 3)
    axis, folds = splits.purged_walk_forward(df, "d", 4, 5, 60)
    rows = splits.assign(axis, folds, ["d", "e"])
    assert splits.temporal_overlap(rows, "d", embargo=5).count() == 0
    assert splits.temporal_overlap(rows, "d", embargo=6).count() == 4
    mixed = rows.groupBy("fold", "d").agg(F.count_distinct("role").alias("k")).filter("k > 1").count()
    assert mixed == 0 and max(r.d for r in rows.filter("role = 'test'").select("d").collect()) == dates[-1]
    with pytest.raises(ValueError):
        splits.purged_walk_forward(df, "d", 4, 5, 195)


def test_stratified_folds_test_every_row_once_per_repeat(spark, split_small):
    df = spark.range(300).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = splits.stratified_folds(df, "id", "y", 5, 2)
    assert got.count() == 600 and got.groupBy("id", "repeat").count().filter("count > 1").count() == 0
    per = got.groupBy("repeat", "fold").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.p == 6 and r.n == 60 for r in per)


def test_walk_forward_by_group_purges_and_checks_the_number_of_groups(spark):
    df = spark.range(100).select("id", (F.col("id") / 5).cast("int").alias("g"))
    got = splits.walk_forward_by_group(df, "g", ["id"], purge=2)
    assert {r.role: r["count"] for r in got.groupBy("role").count().collect()} == {"train": 58, "validation": 20, "test": 20}
    assert got.filter("id in (58, 59)").count() == 0
    with pytest.raises(ValueError):
        splits.walk_forward_by_group(df.filter("g < 10"), "g", ["id"])


def test_holdout_needs_rows(spark):
    with pytest.raises(ValueError):
        splits.holdout_by_time(spark.createDataFrame([(1,)], "t int"), "t", 5)


# ------------------------------------------------------------------------------------- sources
def test_contract_and_projection(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 1)], "Customer_ID long, a double, b double, Default_Flag int")
    assert tables.feature_columns(df, specs.TABLES["loans"]) == ["a", "b"]
    with pytest.raises(ValueError):
        tables.feature_columns(df.select("Customer_ID", "Default_Flag"), specs.TABLES["loans"])
    assert tables.check_contract(df, ["b", "a"], strict=False).columns == ["b", "a"]
    with pytest.raises(ValueError, match="missing"):
        tables.check_contract(df, ["a", "zz"])
    with pytest.raises(ValueError, match="unexpected"):
        tables.check_contract(df, ["a"])
    every_target = {"fwd_outflows_5d", "fwd_inflows_5d", "Liquidity_Gap", "Expected_Outflows"}
    assert every_target <= specs.TABLES["liquidity"].forbidden_features


def test_malformed_csv_stops_the_job(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2020-01-31\nx,2020-02-01\n")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DateType())])
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_csv(spark, str(tmp_path / "t.csv"), schema, {"b": "yyyy-MM-dd"}).collect()


def test_strict_audit_and_digest(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "Customer_ID long, Default_Flag int")
    with pytest.raises(ValueError):
        tables.schema_audit(df, specs.TABLES["loans"], strict=True)
    assert one(tables.table_digest(df)) == one(tables.table_digest(df.repartition(3)))
    assert one(tables.table_digest(df)) != one(tables.table_digest(df.withColumn("Default_Flag", F.lit(0))))
    assert tables.narrow(df).schema["Customer_ID"].dataType.simpleString() == "tinyint"


def test_duplicates_and_overlap_with_a_heavy_key(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("b", i) for i in range(20)] + [(None, None)] * 2, "k string, v int")
    assert one(audit.duplicate_rows(df)).n_duplicates == 50
    got = {(r.left_table, r.right_table): r.n_shared for r in audit.entity_overlap({"x": (df, "k"), "y": (df.filter("k = 'a'"), "k"), "z": (df.limit(0), "k")}).collect()}
    assert got["x", "x"] == 2 and got["x", "y"] == 1 and got["x", "z"] == 0


def test_irr_solves_batches_of_rows(spark):
    """The halving runs over batches, not inside one expression per row; rates are those of plain halving."""
    rows = [(float(k), 40.0 + k % 60, None if k % 50 == 7 else 30.0 - k % 80, 100.0 + k % 9) for k in range(400)]
    got = spark.createDataFrame(rows, "k double, a double, b double, i double").select("k", "a", "b", "i", money.irr(["a", "b"], "i").alias("r"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan

    def plain(a, b, i):
        value = lambda r: a / (1 + r) + b / (1 + r) ** 2 - i
        lo, hi = -0.99, 10.0
        if value(lo) * value(hi) > 0:
            return None
        for _ in range(100):
            middle = (lo + hi) / 2
            lo, hi = (lo, middle) if value(lo) * value(middle) <= 0 else (middle, hi)
        return (lo + hi) / 2 if (lo + hi) / 2 > -0.98 else None

    want = {k: None if b is None else plain(a, b, i) for k, a, b, i in rows}
    found = {r.k: r.r for r in got.collect()}
    assert {k for k, v in want.items() if v is None} == {k for k, v in found.items() if v is None}
    assert sum(v is not None for v in want.values()) > 100
    assert all(found[k] == pytest.approx(v, abs=1e-9) for k, v in want.items() if v is not None)


def test_dealt_labels_equal_a_sort_of_all_rows(spark):
    """Positives are dealt by counts per cell, not by ordering every replicate; equal numbers and keys share a cell."""
    r = random.Random(3)
    rows = [(k, None if k < 200 else k, float(r.randrange(20)), rep, 0.5 if k < 200 else r.random()) for rep in (1, 2, 3) for k in range(3000)]
    reps = spark.createDataFrame(rows, "n int, key int, score double, rep int, u double")
    for positives in (0, 7, 1450, 1550, 3000):
        got = {(x.rep, x.score): (x.pos, x.neg) for x in metrics.dealt_counts(reps, "key", positives).collect()}
        for rep in (1, 2, 3):
            order = sorted((x for x in rows if x[3] == rep), key=lambda x: (x[4], x[1] is not None, x[1] or 0, x[2]))
            for score in range(20):
                n = sum(x[2] == score for x in order)
                pos = sum(x[2] == score for x in order[:positives])
                assert got[rep, float(score)] == (pos, n - pos)


def test_bootstrap_draws_once(spark, monkeypatch):
    df, seen = scores(spark, [0, 1] * 30, range(60)), []
    monkeypatch.setattr(metrics, "materialise", lambda d, name: seen.append(name) or d)
    assert one(metrics.bootstrap_auc(df, "y", "s", "id", replicates=5)).n_boot == 5 and seen == ["replicates"]


def evaluated(spark, df, name, seen):
    """The table with a column whose values are counted each time they are computed."""
    @F.udf("double")
    def same(x):
        seen.add(1)
        return x

    return df.withColumn(name, same.asNondeterministic()(name))


def test_customers_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)
    df = spark.range(50).select("id", (F.col("id") * 7 % 50).cast("double").alias("v"), (F.col("id") % 9).cast("double").alias("c"), (F.col("id") % 5).cast("double").alias("u"))
    out = money.prioritise(evaluated(spark, df, "v", seen), "v", "c", "id", budget=3).collect()
    assert seen.value == 50 and sum(x.contact for x in out) == 3
    out = money.churn_proxy(evaluated(spark, df, "c", other := spark.sparkContext.accumulator(0)), "c", "u")
    assert out.count() == 50 and out.filter("churn_p > 0").count() > 40 and other.value == 50


def test_folds_are_scored_once(spark):
    from ledgerline.operators import modeling

    seen = spark.sparkContext.accumulator(0)
    df = spark.range(60).select((F.col("id") % 2).cast("double").alias("label"), (F.col("id") / 60).alias("score"), (F.col("id") % 3).cast("int").alias("fold"))
    out = modeling.fold_metrics(evaluated(spark, df, "score", seen), "binary")
    assert out.filter("metric = 'roc_auc'").count() == 3 and out.count() > 20 and seen.value == 60
