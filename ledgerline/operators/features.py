"""Feature tables for the eight business tables.

Every builder takes a DataFrame with the business columns and returns it with new columns.
Columns that look at other rows only look backwards, through ``ordered.causal``; the forward
targets are the one exception and are listed in the contracts of ``sources.specs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bands import band
from ..functions.normal import norm_pdf
from ..functions.scalar import (
    cyclical, finite, flag, is_month_end, is_quarter_end, matched, present_cash_flow, quarter_label,
    safe_div, seconds_between, weekday,
)
from ..sources import specs
from .ordered import average_ranks, causal, expanding, find_cut, lag, lead, one_row_per_day, prior_count, rolling

c = F.col


# ----------------------------------------------------------------------------------------------
# Row-wise builders
# ----------------------------------------------------------------------------------------------
def appraisal_features(df: DataFrame, discount_rate: float = specs.DISCOUNT_RATE) -> DataFrame:
    """Capital-budgeting figures of a project with three years of revenue."""
    revenues = ["Revenue_Year1", "Revenue_Year2", "Revenue_Year3"]
    nets = [c(r) - c("Operating_Cost") for r in revenues]
    df = df.withColumns({
        "total_revenue": c(revenues[0]) + c(revenues[1]) + c(revenues[2]),
        "total_cost": c("Operating_Cost") * 3 + c("Initial_Investment"),
        "_pv": present_cash_flow(nets, discount_rate),
    })
    df = df.withColumns({
        "gross_profit": c("total_revenue") - c("Operating_Cost") * 3,
        "npv": c("_pv") - c("Initial_Investment"),
    })
    invested = c("Initial_Investment")
    return df.withColumns({
        "profitability_index": safe_div("_pv", invested),
        "npv_per_rupee": safe_div("npv", invested),
        "revenue_cagr": finite(F.sqrt(safe_div(revenues[2], revenues[0]))) - 1,
        "revenue_growth_y2": safe_div(revenues[1], revenues[0]) - 1,
        "revenue_growth_y3": safe_div(revenues[2], revenues[1]) - 1,
        "cost_to_revenue": safe_div(c("Operating_Cost") * 3, "total_revenue"),
        "margin": safe_div("gross_profit", "total_revenue"),
        "payback_years": F.when(nets[0] >= invested, 1.0)
        .when(nets[0] + nets[1] >= invested, 2.0)
        .when(nets[0] + nets[1] + nets[2] >= invested, 3.0)
        .otherwise(4.0),
        "growth_vs_gdp": c("Business_Growth") - c("GDP_Growth"),
        "roi_vs_rate": c("Expected_ROI") - c("Interest_Rate"),
        "roi_gap": c("Expected_ROI") - safe_div(c("gross_profit") - invested, invested) * 100,
        "competition_pressure": c("Competition_Index") / 100.0,
        "risk_adjusted_roi": c("Expected_ROI") * (1 - c("Competition_Index") / 100.0),
        "investment_log": F.log1p(invested),
    }).drop("_pv")


def credit_features(df: DataFrame) -> DataFrame:
    """Leverage, affordability and borrower quality of a loan, from its own row only."""
    loan, income, term = c("Loan_Amount"), c("Annual_Income"), c("Loan_Term_Months")
    monthly = c("Interest_Rate") / 1200.0
    growth = F.pow(1 + monthly, term.cast("double"))
    df = df.withColumns({
        "ltv": safe_div(loan, "Collateral_Value"),
        "total_debt": loan + c("Existing_Loan"),
        "emi": safe_div(loan * monthly * growth, growth - 1),
        "credit_score_norm": (c("Credit_Score") - 300) / 550.0,
    })
    df = df.withColumn("total_interest", c("emi") * term - loan)
    return df.withColumns({
        "collateral_coverage": safe_div("Collateral_Value", loan),
        "under_collateralised": flag(c("ltv") > 1),
        "loan_to_income": safe_div(loan, income),
        "existing_to_income": safe_div("Existing_Loan", income),
        "total_debt_to_income": safe_div("total_debt", income),
        "emi_to_monthly_income": safe_div(c("emi") * 12, income),
        "interest_to_principal": safe_div("total_interest", loan),
        "credit_band": band("Credit_Score", specs.CREDIT_BAND_EDGES, specs.CREDIT_BAND_LABELS),
        "income_log": F.log1p(income),
        "loan_log": F.log1p(loan),
        "employment_stability": c("Employment_Length") / 30.0,
        "dti_x_past_default": c("Debt_to_Income") * c("Past_Default"),
        "score_x_dti": c("credit_score_norm") * (1 - c("Debt_to_Income")),
        "term_years": term / 12.0,
    })


def engagement_score() -> Column:
    return c("Digital_Usage") / 100 * 0.4 + (c("Transactions_Per_Month") / 35) * 0.3 + (c("Products_Held") / 6) * 0.3


def customer_features(df: DataFrame) -> DataFrame:
    """Balances, ratios and engagement of a customer, from its own row only."""
    account, invested, loan = c("Account_Balance"), c("Investment_Balance"), c("Loan_Balance")
    df = df.withColumn("total_balance", account + invested + loan)
    return df.withColumns({
        "net_worth_proxy": account + invested - loan,
        "balance_to_income": safe_div(account, "Annual_Income"),
        "investment_share": safe_div(invested, "total_balance"),
        "loan_to_balance": safe_div(loan, account),
        "leverage": safe_div(loan, "total_balance"),
        "complaints_per_year": safe_div("Complaints", "Relationship_Length_Years"),
        "has_complaints": flag(c("Complaints") > 0),
        "products_per_year": safe_div("Products_Held", "Relationship_Length_Years"),
        "txn_per_product": safe_div("Transactions_Per_Month", "Products_Held"),
        "digital_engaged": flag(c("Digital_Usage") > 50),
        "engagement_score": engagement_score(),
        "tenure_ratio": safe_div("Relationship_Length_Years", F.greatest(c("Age") - 18, F.lit(1))),
        "income_log": F.log1p("Annual_Income"),
        "balance_log": F.log1p("Account_Balance"),
        "age_band": band("Age", specs.AGE_BAND_EDGES, specs.AGE_BAND_LABELS),
    })


def customer_priority(df: DataFrame) -> DataFrame:
    """Population ranks for the contact decision; never model inputs."""
    df = average_ranks(df, [], {
        "decision_value_rank": "Estimated_CLV", "_complaints": "complaints_per_year", "_engagement": "engagement_score",
    })
    df = df.withColumn("decision_attrition_proxy", c("_complaints") * 0.6 + (1 - c("_engagement")) * 0.4)
    df = df.withColumn("decision_priority_score", c("decision_value_rank") * c("decision_attrition_proxy"))
    return df.drop("_complaints", "_engagement")


def option_features(df: DataFrame) -> DataFrame:
    """Moneyness, variance, d1/d2 and two sensitivities for a whole option book."""
    eps = F.lit(specs.RATIO_FLOOR)
    is_call = c("Option_Type") == "Call"
    df = df.withColumns({
        "is_call": flag(is_call),
        "moneyness": safe_div("Spot", "Strike"),
        "in_the_money": flag(F.when(is_call, c("Spot") > c("Strike")).otherwise(c("Spot") < c("Strike"))),
        "intrinsic_value": F.when(is_call, F.greatest(c("Spot") - c("Strike"), F.lit(0.0))).otherwise(
            F.greatest(c("Strike") - c("Spot"), F.lit(0.0))),
        "sqrt_time": F.sqrt("Time_to_Maturity"),
        "total_variance": c("Volatility") * c("Volatility") * c("Time_to_Maturity"),
        "discount_factor": F.exp(-c("Interest_Rate") * c("Time_to_Maturity")),
        "carry": c("Interest_Rate") * c("Time_to_Maturity"),
    })
    df = df.withColumns({
        "log_moneyness": F.ln("moneyness"),
        "vol_sqrt_t": c("Volatility") * c("sqrt_time"),
    })
    drift = (c("Interest_Rate") + 0.5 * c("Volatility") * c("Volatility")) * c("Time_to_Maturity")
    df = df.withColumns({
        "standardised_moneyness": safe_div("log_moneyness", c("vol_sqrt_t") + eps),
        "d1": safe_div(c("log_moneyness") + drift, c("vol_sqrt_t") + eps),
    })
    return df.withColumns({
        "d2": c("d1") - c("vol_sqrt_t"),
        "vega": c("Spot") * norm_pdf("d1") * c("sqrt_time"),
        "gamma": safe_div(norm_pdf("d1"), c("Spot") * c("vol_sqrt_t") + eps),
        "time_value": c("Market_Price") - c("intrinsic_value"),
        "maturity_bucket": band("Time_to_Maturity", specs.MATURITY_EDGES, specs.MATURITY_LABELS),
        "expiry_bucket": quarter_label("Expiry"),
    })


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    """Hour, weekday (Monday 0), weekend and night flags, hour on a circle."""
    sine, cosine = cyclical(F.hour(ts), 24)
    return df.withColumns({
        "hour": F.hour(ts),
        "day_of_week": weekday(ts),
        "is_weekend": flag(weekday(ts) >= 5),
        "is_night": flag((F.hour(ts) < 6) | (F.hour(ts) >= 22)),
        "hour_sin": sine,
        "hour_cos": cosine,
    })


# ----------------------------------------------------------------------------------------------
# History builders
# ----------------------------------------------------------------------------------------------
def transaction_features(df: DataFrame, key: str = "Transaction_ID") -> DataFrame:
    """Behaviour of a payment against the past of its customer and of its device."""
    order = ["Timestamp", key]
    df = calendar_features(df, "Timestamp").withColumns({
        "amount_vs_history": safe_div("Amount", "Historical_Avg_Transaction"),
        "amount_log": F.log1p("Amount"),
        "amount_excess": c("Amount") - c("Historical_Avg_Transaction"),
        "account_age_years": c("Account_Age_Months") / 12.0,
        "new_account": flag(c("Account_Age_Months") < 12),
        "txn_frequency_norm": c("Transaction_Frequency") / 27.0,
    })
    df = causal(df, ["Customer_ID"], order, {
        "cust_prev_amount": lag("Amount"),
        "cust_mean_amount_5": rolling("Amount", 5, "mean"),
        "cust_std_amount_5": rolling("Amount", 5, "std"),
        "cust_max_amount_10": rolling("Amount", 10, "max"),
        "cust_mean_amount_all": expanding("Amount", "mean"),
        "cust_txn_count": prior_count(),
        "_prev_time": lag("Timestamp"),
    })
    df = causal(df, ["Device_ID"], order, {
        "device_txn_count": prior_count(),
        "device_mean_amount": expanding("Amount", "mean"),
        "_prev_customer": lag("Customer_ID"),
    })
    df = df.withColumn("seconds_since_prev", seconds_between("Timestamp", "_prev_time"))
    return df.withColumns({
        "amount_vs_cust_mean": safe_div("Amount", "cust_mean_amount_5"),
        "amount_z_vs_cust": safe_div(c("Amount") - c("cust_mean_amount_5"), "cust_std_amount_5"),
        "amount_vs_cust_max": safe_div("Amount", "cust_max_amount_10"),
        "hours_since_prev": c("seconds_since_prev") / 3600.0,
        "rapid_repeat": flag(c("seconds_since_prev") < 3600),
        "amount_vs_device_mean": safe_div("Amount", "device_mean_amount"),
        "device_customer_changed": flag(c("_prev_customer").isNotNull() & (c("_prev_customer") != c("Customer_ID"))),
    }).drop("_prev_time", "_prev_customer")


def panel_features(df: DataFrame, horizon: int = specs.EQUITY_HORIZON) -> DataFrame:
    """Lags, trailing statistics and same-day ranks of an entity-by-date panel, with targets."""
    eps = F.lit(specs.RATIO_FLOOR)
    base, df = df, df.withColumn("volume_log", F.log1p("Volume"))
    df = causal(df, ["Ticker"], ["Date"], {
        f"fwd_return_{horizon}d": lead("Return", horizon),
        "fwd_return_5d": lead("Return", 5),
        **{f"ret_lag_{k}": lag("Return", k) for k in (1, 2, 3, 5, 10)},
        "ret_mean_5": rolling("Return", 5, "mean"),
        "ret_mean_20": rolling("Return", 20, "mean"),
        "ret_std_5": rolling("Return", 5, "std"),
        "ret_std_20": rolling("Return", 20, "std"),
        "ret_median_20": rolling("Return", 20, "median"),
        "volume_mean_20": rolling("volume_log", 20, "mean"),
        "_market_lag": lag("Market_Return"),
        "vix_lag1": lag("VIX"),
        "_vix_mean": rolling("VIX", 20, "mean"),
    }, bounded=one_row_per_day(df, "Date"))
    df = df.withColumns({
        "momentum_ratio": safe_div("ret_mean_5", c("ret_std_20") + eps),
        "vol_ratio": safe_div("ret_std_5", c("ret_std_20") + eps),
        "risk_adj_momentum": safe_div("Momentum_20D", c("Volatility_20D") + eps),
        "volume_surprise": c("volume_log") - c("volume_mean_20"),
        "excess_return_lag1": c("ret_lag_1") - c("_market_lag"),
        "vix_change": c("vix_lag1") - c("_vix_mean"),
        "high_vol_regime": flag(c("vix_lag1") > 20),
        "_reversal": -c("ret_lag_1"),
    })
    # One size check serves the ranks and the sector means: both look at the rows of one day.
    whole_days = find_cut(base, ["Date"], "Momentum_20D") is None
    df = average_ranks(df, ["Date"], {
        "rank_momentum": "Momentum_20D", "rank_volatility": "Volatility_20D",
        "rank_reversal": "_reversal", "rank_volume_surprise": "volume_surprise",
    }, probe=base, bounded=whole_days)
    df = group_relative(df, ["Date", "Sector"], "Momentum_20D", "momentum_vs_sector", bounded=whole_days)
    return df.drop("_market_lag", "_vix_mean", "_reversal").filter(c(f"fwd_return_{horizon}d").isNotNull())


def group_relative(df: DataFrame, by: list[str], value: str, name: str, bounded: bool = False) -> DataFrame:
    """Value minus the mean of its group.

    Means are aggregated before they meet the rows, so a group of any size is fine.  Groups known to
    be ``bounded`` use a window, which needs no second pass and shares a shuffle with its neighbours.
    """
    if bounded:
        return df.withColumn(name, c(value) - F.avg(value).over(Window.partitionBy(*by)))
    means = df.groupBy(*by).agg(F.avg(value).alias("_mean"))
    return matched(df, means, by, "left").withColumn(name, c(value) - c("_mean")).drop("_mean")


def series_features(df: DataFrame, by: list[str] | None = None, horizon: int = specs.LIQUIDITY_HORIZON) -> DataFrame:
    """Lags and trailing statistics of one time series per ``by`` key, with targets ahead."""
    base = [
        "Deposits", "Loan_Disbursements", "Loan_Repayments", "Wholesale_Funding",
        "Expected_Inflows", "Expected_Outflows", "Market_Stress", "Interest_Rate",
    ]
    wanted = {
        f"fwd_outflows_{horizon}d": lead("Expected_Outflows", horizon),
        f"fwd_inflows_{horizon}d": lead("Expected_Inflows", horizon),
        "_cash": lag("Cash"), "_securities": lag("Securities_Holdings"),
    }
    for name in base:
        low = name.lower()
        wanted |= {f"{low}_lag_{k}": lag(name, k) for k in (1, 2, 5)}
        wanted |= {
            f"{low}_ma_5": rolling(name, 5, "mean"), f"{low}_ma_20": rolling(name, 20, "mean"),
            f"{low}_std_20": rolling(name, 20, "std"),
        }
    df = causal(df, by or [], ["Date"], wanted, bounded=one_row_per_day(df, "Date"))
    df = df.withColumn("liquid_assets_lag1", c("_cash") + c("_securities"))
    return df.withColumns({
        "net_loan_flow_lag1": c("loan_disbursements_lag_1") - c("loan_repayments_lag_1"),
        "funding_ratio_lag1": safe_div("wholesale_funding_lag_1", "deposits_lag_1"),
        "coverage_lag1": safe_div("expected_inflows_lag_1", "expected_outflows_lag_1"),
        "lcr_proxy_lag1": safe_div("liquid_assets_lag1", "expected_outflows_lag_1"),
        "stress_flag_lag1": flag(c("market_stress_lag_1") > 1.5),
        "day_of_week": weekday("Date"),
        "month": F.month("Date"),
        "is_month_end": is_month_end("Date"),
        "is_quarter_end": is_quarter_end("Date"),
    }).drop("_cash", "_securities").filter(c(f"fwd_outflows_{horizon}d").isNotNull())


def book_static_features(df: DataFrame) -> DataFrame:
    """Shape of the order book at one tick."""
    per_mid = lambda x: safe_div(x, "Mid_Price") * 10000
    bids, asks = c("Bid_Size_1"), c("Ask_Size_1")
    return df.withColumns({
        "spread_bps": per_mid("Spread"),
        "depth_imbalance_1": safe_div(bids - asks, bids + asks),
        "depth_imbalance_all": safe_div(
            bids + c("Bid_Size_2") + c("Bid_Size_3") - (asks + c("Ask_Size_2") + c("Ask_Size_3")), "Total_Depth"),
        "book_slope_bid": safe_div(c("Bid_Price_1") - c("Bid_Price_3"), bids + c("Bid_Size_3")),
        "book_slope_ask": safe_div(c("Ask_Price_3") - c("Ask_Price_1"), asks + c("Ask_Size_3")),
        "microprice_dev_bps": per_mid("Microprice_Minus_Mid"),
        "flow_pressure": safe_div("Order_Arrival_Rate", c("Cancellation_Rate") + F.lit(specs.RATIO_FLOOR)),
        "log_depth": F.log1p("Total_Depth"),
        "trade_volume_log": F.log1p("Trade_Volume"),
        "is_buy": flag(c("Trade_Side") == "BUY"),
        "is_market_order": flag(c("Event_Type") == "MARKET_ORDER"),
        "is_cancel": flag(c("Event_Type") == "CANCEL"),
    })


def tape_features(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Order-book shape and its history within one stock and trading day."""
    df = causal(book_static_features(df), ["Stock", "Trading_Day"], ["Timestamp", seq], {
        "obi_lag_1": lag("OBI_Level1"),
        "obi_mean_10": rolling("OBI_Level1", 10, "mean"),
        "obi_mean_50": rolling("OBI_3Level", 50, "mean"),
        "mid_lag_1": lag("Mid_Price"),
        "mid_mean_20": rolling("Mid_Price", 20, "mean"),
        "spread_mean_20": rolling("Relative_Spread", 20, "mean"),
        "volume_mean_20": rolling("trade_volume_log", 20, "mean"),
        "buy_pressure_20": rolling("is_buy", 20, "mean"),
        "cancel_rate_20": rolling("is_cancel", 20, "mean"),
        "tick_index": prior_count(),
    })
    return df.withColumns({
        "obi_change": c("OBI_Level1") - c("obi_lag_1"),
        "obi_vs_mean": c("OBI_Level1") - c("obi_mean_10"),
        "mid_return_bps": safe_div(c("Mid_Price") - c("mid_lag_1"), "mid_lag_1") * 10000,
        "mid_vs_mean_bps": safe_div(c("Mid_Price") - c("mid_mean_20"), "mid_mean_20") * 10000,
        "spread_vs_mean": c("Relative_Spread") - c("spread_mean_20"),
        "volume_surprise": c("trade_volume_log") - c("volume_mean_20"),
    })


def pct_change(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Relative change against the previous row of the group."""
    out = causal(df, by, order, {"_prev": lag(value)}, bounded=len(order) == 1 and one_row_per_day(df, order[0]))
    return out.withColumn(name, safe_div(value, "_prev") - 1).drop("_prev")


# ----------------------------------------------------------------------------------------------
# Proof that features do not look ahead
# ----------------------------------------------------------------------------------------------
def causality_proof(
    df: DataFrame, build, key: str | list[str], order: str, cut, corrupt: list[str], features: list[str],
) -> DataFrame:
    """Build on the table and on a copy whose late rows are corrupted; count early features that moved.

    One row per feature with the number of early rows compared and of those that differ.  Early
    means ``order < cut``.  Numbers are turned and shifted, texts changed (so late rows change
    groups), dates and times moved further on; the key stays.  Values are compared bit for bit,
    NULL equal to NULL: cumulative sums do not depend on where groups are cut.
    """
    keys = [key] if isinstance(key, str) else list(key)
    late = c(order) >= F.lit(cut)
    damaged = df.withColumns({n: F.when(late, _damage(n, df.schema[n].dataType)).otherwise(c(n)) for n in corrupt})
    left = build(df).filter(~late).select(*keys, *features, F.lit(True).alias("_left"))
    right = build(damaged).filter(~late).select(*keys, *[c(f).alias(f"{f}__b") for f in features], F.lit(True).alias("_right"))
    both = matched(left, right, keys, "full")
    one_sided = c("_left").isNull() | c("_right").isNull()
    moved = both.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(one_sided | ~c(f).eqNullSafe(c(f"{f}__b"))).alias(f) for f in features],
    )
    pairs = ", ".join(f"'{f}', `{f}`" for f in features)
    return moved.selectExpr("n AS n_compared", f"stack({len(features)}, {pairs}) AS (feature, n_changed)").withColumn(
        "is_causal", c("n_changed") == 0)


def _damage(name: str, kind: T.DataType) -> Column:
    """Another value of the same type that no honest early feature can see."""
    if isinstance(kind, T.StringType):
        return F.concat(F.lit("~"), c(name))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return (c(name) + F.expr("INTERVAL 5 DAYS")).cast(kind)
    return (-(c(name).cast("double")) * 7 - 13).cast(kind)


def simple_equity(returns: str) -> Column:
    """log growth of one period, guarded against a total loss."""
    return F.when(c(returns) > -1, F.log1p(c(returns)))


