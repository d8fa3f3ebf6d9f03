"""Row-wise features, money, risk bands, portfolios, market risk and allocation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import bands, normal, scalar
from ..operators import allocation, money, portfolio
from ..operators import features as fx
from ..session import fresh_dir, materialise
from ..streaming import scoring
from .registry import query


def cdf_sql(x):
    """The same rational normal distribution function as text."""
    a = f"abs({x})"

    def poly(coefficients):
        out = repr(coefficients[0])
        for v in coefficients[1:]:
            out = f"({out} * {a} + {v!r}::DOUBLE)"
        return out

    fraction = f"({a} + 0.65::DOUBLE)"
    for k in (4, 3, 2, 1):
        fraction = f"({a} + {k} / {fraction})"
    tail = f"""(CASE WHEN {a} < {normal.HART_SWITCH!r} THEN exp(-0.5 * {a} * {a}) * {poly(normal.HART_NUMERATOR)} / {poly(normal.HART_DENOMINATOR)}
       ELSE exp(-0.5 * {a} * {a}) / {fraction} / {normal.SQRT_TWO_PI!r} END)"""
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


# ----------------------------------------------------------------------------------------------
# Row-wise features
# ----------------------------------------------------------------------------------------------
AP_OUT = {n: 6 for n in (
    "total_revenue", "total_cost", "gross_profit", "npv", "profitability_index", "npv_per_rupee", "revenue_cagr", "revenue_growth_y2", "revenue_growth_y3",
    "cost_to_revenue", "margin", "payback_years", "growth_vs_gdp", "roi_vs_rate", "roi_gap", "competition_pressure", "risk_adjusted_roi", "investment_log")}


@query(
    "appraisal_features",
    """WITH a AS (SELECT *, Revenue_Year1 - Operating_Cost AS n1, Revenue_Year2 - Operating_Cost AS n2, Revenue_Year3 - Operating_Cost AS n3, Initial_Investment AS inv,
        Revenue_Year1 + Revenue_Year2 + Revenue_Year3 AS total_revenue FROM initiatives),
    b AS (SELECT *, n1 / 1.12 + n2 / power(1.12, 2) + n3 / power(1.12, 3) AS pv, total_revenue - Operating_Cost * 3 AS gross_profit FROM a)
    SELECT Initiative_ID, total_revenue, Operating_Cost * 3 + inv AS total_cost, gross_profit, pv - inv AS npv, pv / nullif(inv, 0) AS profitability_index,
      (pv - inv) / nullif(inv, 0) AS npv_per_rupee, sqrt(Revenue_Year3 / nullif(Revenue_Year1, 0)) - 1 AS revenue_cagr, Revenue_Year2 / nullif(Revenue_Year1, 0) - 1 AS revenue_growth_y2,
      Revenue_Year3 / nullif(Revenue_Year2, 0) - 1 AS revenue_growth_y3, Operating_Cost * 3 / nullif(total_revenue, 0) AS cost_to_revenue, gross_profit / nullif(total_revenue, 0) AS margin,
      CASE WHEN n1 >= inv THEN 1.0 WHEN n1 + n2 >= inv THEN 2.0 WHEN n1 + n2 + n3 >= inv THEN 3.0 ELSE 4.0 END AS payback_years, Business_Growth - GDP_Growth AS growth_vs_gdp,
      Expected_ROI - Interest_Rate AS roi_vs_rate, Expected_ROI - (gross_profit - inv) / nullif(inv, 0) * 100 AS roi_gap, Competition_Index / 100 AS competition_pressure,
      Expected_ROI * (1 - Competition_Index / 100) AS risk_adjusted_roi, ln(1 + inv) AS investment_log FROM b""",
    AP_OUT,
)
def _(t):
    return fx.appraisal_features(t.initiatives).select("Initiative_ID", *AP_OUT)


CR_OUT = {n: 6 for n in (
    "ltv", "collateral_coverage", "loan_to_income", "existing_to_income", "total_debt", "total_debt_to_income", "emi", "emi_to_monthly_income", "interest_to_principal",
    "credit_score_norm", "income_log", "loan_log", "employment_stability", "dti_x_past_default", "score_x_dti", "term_years")} | {"emi": 4, "total_interest": 2}


@query(
    "credit_features",
    """WITH a AS (SELECT *, Interest_Rate / 1200.0 AS m, power(1 + Interest_Rate / 1200.0, Loan_Term_Months) AS f, Loan_Amount + Existing_Loan AS total_debt, (Credit_Score - 300) / 550.0 AS cs FROM loans),
    b AS (SELECT *, Loan_Amount * m * f / nullif(f - 1, 0) AS emi FROM a)
    SELECT Customer_ID, Loan_Amount / nullif(Collateral_Value, 0) AS ltv, Collateral_Value / nullif(Loan_Amount, 0) AS collateral_coverage,
      CASE WHEN Loan_Amount / nullif(Collateral_Value, 0) > 1 THEN 1 ELSE 0 END AS under_collateralised, Loan_Amount / nullif(Annual_Income, 0) AS loan_to_income,
      Existing_Loan / nullif(Annual_Income, 0) AS existing_to_income, total_debt, total_debt / nullif(Annual_Income, 0) AS total_debt_to_income, emi,
      emi * 12 / nullif(Annual_Income, 0) AS emi_to_monthly_income, emi * Loan_Term_Months - Loan_Amount AS total_interest,
      (emi * Loan_Term_Months - Loan_Amount) / nullif(Loan_Amount, 0) AS interest_to_principal, cs AS credit_score_norm,
      CASE WHEN Credit_Score <= 0 THEN NULL WHEN Credit_Score <= 580 THEN 'poor' WHEN Credit_Score <= 670 THEN 'fair' WHEN Credit_Score <= 740 THEN 'good'
        WHEN Credit_Score <= 800 THEN 'very_good' WHEN Credit_Score <= 900 THEN 'excellent' END AS credit_band,
      ln(1 + Annual_Income) AS income_log, ln(1 + Loan_Amount) AS loan_log, Employment_Length / 30.0 AS employment_stability, Debt_to_Income * Past_Default AS dti_x_past_default,
      cs * (1 - Debt_to_Income) AS score_x_dti, Loan_Term_Months / 12.0 AS term_years FROM b""",
    CR_OUT,
)
def _(t):
    return fx.credit_features(t.loans).select("Customer_ID", "under_collateralised", "credit_band", *CR_OUT)


CU_OUT = {n: 6 for n in (
    "total_balance", "net_worth_proxy", "balance_to_income", "investment_share", "loan_to_balance", "leverage", "complaints_per_year", "products_per_year",
    "txn_per_product", "engagement_score", "tenure_ratio", "income_log", "balance_log")}


@query(
    "customer_features",
    """WITH a AS (SELECT *, Account_Balance + Investment_Balance + Loan_Balance AS tb FROM customers)
    SELECT Customer_ID, tb AS total_balance, Account_Balance + Investment_Balance - Loan_Balance AS net_worth_proxy, Account_Balance / nullif(Annual_Income, 0) AS balance_to_income,
      Investment_Balance / nullif(tb, 0) AS investment_share, Loan_Balance / nullif(Account_Balance, 0) AS loan_to_balance, Loan_Balance / nullif(tb, 0) AS leverage,
      Complaints / nullif(Relationship_Length_Years, 0) AS complaints_per_year, CASE WHEN Complaints > 0 THEN 1 ELSE 0 END AS has_complaints,
      Products_Held / nullif(Relationship_Length_Years, 0) AS products_per_year, Transactions_Per_Month / nullif(Products_Held, 0) AS txn_per_product,
      CASE WHEN Digital_Usage > 50 THEN 1 ELSE 0 END AS digital_engaged, Digital_Usage / 100 * 0.4 + (Transactions_Per_Month / 35) * 0.3 + (Products_Held / 6) * 0.3 AS engagement_score,
      Relationship_Length_Years / greatest(Age - 18, 1) AS tenure_ratio, ln(1 + Annual_Income) AS income_log, CASE WHEN Account_Balance > -1 THEN ln(1 + Account_Balance) END AS balance_log,
      CASE WHEN Age <= 0 THEN NULL WHEN Age <= 30 THEN 'young' WHEN Age <= 45 THEN 'mid' WHEN Age <= 60 THEN 'senior' WHEN Age <= 100 THEN 'retired' END AS age_band FROM a""",
    CU_OUT,
)
def _(t):
    return fx.customer_features(t.customers).select("Customer_ID", "has_complaints", "digital_engaged", "age_band", *CU_OUT)


OP_OUT = {n: 6 for n in (
    "moneyness", "log_moneyness", "intrinsic_value", "sqrt_time", "total_variance", "vol_sqrt_t", "standardised_moneyness", "discount_factor", "carry", "d1", "d2", "vega", "gamma", "time_value")}


@query(
    "option_features",
    f"""WITH a AS (SELECT *, Spot / nullif(Strike, 0) AS mo, Volatility * sqrt(Time_to_Maturity) AS vt FROM options),
    b AS (SELECT *, (ln(mo) + (Interest_Rate + 0.5 * Volatility * Volatility) * Time_to_Maturity) / nullif(vt + 1e-9, 0) AS d1 FROM a),
    c AS (SELECT *, exp(-0.5 * d1 * d1) / {math.sqrt(2 * math.pi)!r} AS pdf FROM b)
    SELECT Option_ID, CASE WHEN Option_Type = 'Call' THEN 1 ELSE 0 END AS is_call, mo AS moneyness, ln(mo) AS log_moneyness,
      CASE WHEN (Option_Type = 'Call' AND Spot > Strike) OR (Option_Type <> 'Call' AND Spot < Strike) THEN 1 ELSE 0 END AS in_the_money,
      CASE WHEN Option_Type = 'Call' THEN greatest(Spot - Strike, 0) ELSE greatest(Strike - Spot, 0) END AS intrinsic_value, sqrt(Time_to_Maturity) AS sqrt_time,
      Volatility * Volatility * Time_to_Maturity AS total_variance, vt AS vol_sqrt_t, ln(mo) / (vt + 1e-9) AS standardised_moneyness, exp(-Interest_Rate * Time_to_Maturity) AS discount_factor,
      Interest_Rate * Time_to_Maturity AS carry, d1, d1 - vt AS d2, Spot * pdf * sqrt(Time_to_Maturity) AS vega, pdf / (Spot * vt + 1e-9) AS gamma,
      Market_Price - CASE WHEN Option_Type = 'Call' THEN greatest(Spot - Strike, 0) ELSE greatest(Strike - Spot, 0) END AS time_value,
      CASE WHEN Time_to_Maturity <= 0 THEN NULL WHEN Time_to_Maturity <= 0.25 THEN 'front' WHEN Time_to_Maturity <= 0.5 THEN 'near' WHEN Time_to_Maturity <= 1.0 THEN 'mid' WHEN Time_to_Maturity <= 2.01 THEN 'long' END AS maturity_bucket,
      year(Expiry) || 'Q' || quarter(Expiry) AS expiry_bucket FROM c""",
    OP_OUT,
)
def _(t):
    return fx.option_features(t.options).select("Option_ID", "is_call", "in_the_money", "maturity_bucket", "expiry_bucket", *OP_OUT)


BK_OUT = {n: 6 for n in (
    "spread_bps", "depth_imbalance_1", "depth_imbalance_all", "book_slope_bid", "book_slope_ask", "microprice_dev_bps", "log_depth", "trade_volume_log")} | {"flow_pressure": 0}


@query(
    "book_static_features",
    """SELECT seq, Spread / nullif(Mid_Price, 0) * 10000 AS spread_bps, (Bid_Size_1 - Ask_Size_1) / nullif(Bid_Size_1 + Ask_Size_1, 0) AS depth_imbalance_1,
      (Bid_Size_1 + Bid_Size_2 + Bid_Size_3 - (Ask_Size_1 + Ask_Size_2 + Ask_Size_3)) / nullif(Total_Depth, 0) AS depth_imbalance_all,
      (Bid_Price_1 - Bid_Price_3) / nullif(Bid_Size_1 + Bid_Size_3, 0) AS book_slope_bid, (Ask_Price_3 - Ask_Price_1) / nullif(Ask_Size_1 + Ask_Size_3, 0) AS book_slope_ask,
      Microprice_Minus_Mid / nullif(Mid_Price, 0) * 10000 AS microprice_dev_bps, Order_Arrival_Rate / (Cancellation_Rate + 1e-9) AS flow_pressure, ln(1 + Total_Depth) AS log_depth,
      ln(1 + Trade_Volume) AS trade_volume_log, CASE WHEN Trade_Side = 'BUY' THEN 1 ELSE 0 END AS is_buy, CASE WHEN Event_Type = 'MARKET_ORDER' THEN 1 ELSE 0 END AS is_market_order,
      CASE WHEN Event_Type = 'CANCEL' THEN 1 ELSE 0 END AS is_cancel FROM tape""",
    BK_OUT,
)
def _(t):
    return fx.book_static_features(t.tape).select("seq", "is_buy", "is_market_order", "is_cancel", *BK_OUT)


@query(
    "calendar_features",
    """SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday, CAST(month(o_orderdate) AS INT) AS month, CASE WHEN CAST(o_orderdate AS DATE) = last_day(o_orderdate) THEN 1 ELSE 0 END AS month_end,
      CASE WHEN CAST(o_orderdate AS DATE) = last_day(o_orderdate) AND month(o_orderdate) % 3 = 0 THEN 1 ELSE 0 END AS quarter_end, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter_label FROM orders""",
)
def _(t):
    d = "o_orderdate"
    return t.orders.select(
        "o_orderkey", scalar.weekday(d).alias("weekday"), F.month(d).alias("month"), scalar.is_month_end(d).alias("month_end"),
        scalar.is_quarter_end(d).alias("quarter_end"), scalar.quarter_label(d).alias("quarter_label"))


@query(
    "cyclical_encoding",
    """SELECT o_orderkey, sin(2 * pi() * month(o_orderdate) / 12) AS month_sin, cos(2 * pi() * month(o_orderdate) / 12) AS month_cos,
       sin(2 * pi() * (isodow(o_orderdate) - 1) / 7) AS weekday_sin, cos(2 * pi() * (isodow(o_orderdate) - 1) / 7) AS weekday_cos FROM orders""",
    {"month_sin": 8, "month_cos": 8, "weekday_sin": 8, "weekday_cos": 8},
)
def _(t):
    df = t.orders.select("o_orderkey", F.month("o_orderdate").alias("month"), scalar.weekday("o_orderdate").alias("weekday"))
    return scalar.encode_cyclical(df, {"month": 12, "weekday": 7})


@query(
    "safe_division",
    "SELECT o_orderkey, o_totalprice / nullif(o_orderkey % 5, 0) AS ratio FROM orders", {"ratio": 4},
)
def _(t):
    return t.orders.select("o_orderkey", scalar.safe_div("o_totalprice", F.col("o_orderkey") % 5).alias("ratio"))


@query(
    "banding",
    """SELECT p_size_band, count(*) AS n FROM (SELECT CASE WHEN p_size <= 0 THEN NULL WHEN p_size <= 10 THEN 's' WHEN p_size <= 25 THEN 'm' WHEN p_size <= 40 THEN 'l' END AS p_size_band FROM part) GROUP BY 1""",
)
def _(t):
    return t.part.groupBy(bands.band("p_size", [0, 10, 25, 40], ["s", "m", "l"]).alias("p_size_band")).agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------------------------------------
# Projects and credit
# ----------------------------------------------------------------------------------------------
NPV_SQL = "(Revenue_Year1 - Operating_Cost) / 1.12 + (Revenue_Year2 - Operating_Cost) / power(1.12, 2) + (Revenue_Year3 - Operating_Cost) / power(1.12, 3)"


def _flows():
    return [F.col(f"Revenue_Year{i}") - F.col("Operating_Cost") for i in (1, 2, 3)]


@query(
    "project_npv",
    f"""SELECT Initiative_ID, {NPV_SQL} - Initial_Investment AS npv, ({NPV_SQL}) / Initial_Investment AS profitability_index,
        success_probability * ({NPV_SQL} - Initial_Investment) + (1 - success_probability) * 10.0 AS expected_npv FROM initiatives""",
    {"npv": 6, "profitability_index": 6, "expected_npv": 6},
)
def _(t):
    df = t.initiatives.withColumn("npv", money.npv(_flows(), 0.12, "Initial_Investment"))
    return df.select(
        "Initiative_ID", "npv", money.profitability_index(_flows(), 0.12, "Initial_Investment").alias("profitability_index"),
        money.expected_npv("npv", "success_probability", 10.0).alias("expected_npv"))


@query(
    "project_irr",
    """WITH RECURSIVE p AS (SELECT Initiative_ID AS id, Revenue_Year1 - Operating_Cost AS a, Revenue_Year2 - Operating_Cost AS b, Revenue_Year3 - Operating_Cost AS c, Initial_Investment AS i FROM initiatives),
    s AS (SELECT id, a, b, c, i, -0.99::DOUBLE AS lo, 10.0::DOUBLE AS hi, 0 AS k FROM p WHERE (a / 0.01 + b / power(0.01, 2) + c / power(0.01, 3) - i) * (a / 11 + b / power(11, 2) + c / power(11, 3) - i) <= 0
      UNION ALL
      SELECT id, a, b, c, i, CASE WHEN neg THEN lo ELSE mid END, CASE WHEN neg THEN mid ELSE hi END, k + 1 FROM (SELECT *, (lo + hi) / 2 AS mid,
        (a / (1 + lo) + b / power(1 + lo, 2) + c / power(1 + lo, 3) - i) * (a / (1 + (lo + hi) / 2) + b / power(1 + (lo + hi) / 2, 2) + c / power(1 + (lo + hi) / 2, 3) - i) <= 0 AS neg FROM s WHERE k < 60)),
    r AS (SELECT id, (lo + hi) / 2 AS irr FROM s WHERE k = 60)
    SELECT p.id AS Initiative_ID, CASE WHEN irr > -0.98 THEN irr END AS irr FROM p LEFT JOIN r USING (id)""",
    {"irr": 8},
)
def _(t):
    return t.initiatives.select("Initiative_ID", money.irr(_flows(), "Initial_Investment").alias("irr"))


@query(
    "project_irr_residual",
    """SELECT Initiative_ID, (a / 0.01 + b / power(0.01, 2) + c / power(0.01, 3) - i) * (a / 11 + b / power(11, 2) + c / power(11, 3) - i) <= 0 AS bracketed, true AS solved
       FROM (SELECT Initiative_ID, Revenue_Year1 - Operating_Cost AS a, Revenue_Year2 - Operating_Cost AS b, Revenue_Year3 - Operating_Cost AS c, Initial_Investment AS i FROM initiatives)""",
)
def _(t):
    """The present value at the returned rate is zero, and there is a rate exactly where the ends of the interval differ in sign."""
    df = t.initiatives.select("Initiative_ID", "Initial_Investment", F.array(*_flows()).alias("f"), money.irr(_flows(), "Initial_Investment").alias("r"))
    value = lambda r: sum(F.get("f", F.lit(k)) / F.pow(1 + r, F.lit(k + 1.0)) for k in range(3)) - F.col("Initial_Investment")
    near = F.abs(value(F.col("r"))) <= 1e-6 * F.greatest(F.col("Initial_Investment"), F.lit(1.0))
    return df.select("Initiative_ID", (value(F.lit(-0.99)) * value(F.lit(10.0)) <= 0).alias("bracketed"), F.coalesce(near, F.lit(True)).alias("solved"))


@query(
    "fund_decision",
    f"""WITH e AS (SELECT Initiative_ID, lower(Risk_Rating) AS r, round(success_probability * ({NPV_SQL} - Initial_Investment) + 20 + @N@, 6) AS v FROM initiatives)
        SELECT Initiative_ID, CASE WHEN v > CASE WHEN r = 'high' THEN 1.5 ELSE 0.0 END THEN 'Fund' WHEN v >= -10 THEN 'Review' ELSE 'Reject' END AS decision FROM e""",
)
def _(t):
    from .views import NUDGE

    value = F.col("success_probability") * money.npv(_flows(), 0.12, "Initial_Investment") + 20
    df = t.initiatives.withColumn("v", F.round(value + NUDGE, 6))
    return df.select("Initiative_ID", money.fund_decision("v", "Risk_Rating").alias("decision"))


CREDIT_SQL = """
e AS (SELECT *, pd * 0.4 * Loan_Amount AS ecl, pd * least(greatest(1 - Collateral_Value / nullif(Loan_Amount, 0), 0), 1) * Loan_Amount AS ecl2, Collateral_Value / nullif(Loan_Amount, 0) AS cover FROM loans),
s AS (SELECT *, ecl / nullif(Loan_Amount, 0) AS ecl_ratio, CASE WHEN pd >= 0 AND pd < 0.05 THEN 'low' WHEN pd >= 0.05 AND pd < 0.15 THEN 'medium' WHEN pd >= 0.15 AND pd < 0.30 THEN 'high' ELSE 'very_high' END AS risk_band,
   CASE WHEN pd < 0.05 AND ecl / nullif(Loan_Amount, 0) < 0.12 THEN 'Approve' WHEN pd >= 0.30 OR ecl / nullif(Loan_Amount, 0) >= 0.24 THEN 'Reject' ELSE 'Review' END AS d FROM e),
scoredloans AS (SELECT *, CASE WHEN d = 'Review' AND cover >= 1.5 AND pd < 0.30 THEN 'Approve' ELSE d END AS decision FROM s)
"""


@query(
    "expected_credit_loss",
    f"WITH {CREDIT_SQL} SELECT Customer_ID, ecl AS ecl_flat, ecl2 AS ecl_secured FROM scoredloans", {"ecl_flat": 4, "ecl_secured": 4},
)
def _(t):
    return t.loans.select(
        "Customer_ID", money.expected_credit_loss("pd", "Loan_Amount").alias("ecl_flat"),
        money.expected_credit_loss("pd", "Loan_Amount", collateral="Collateral_Value").alias("ecl_secured"))


@query(
    "credit_decision",
    f"WITH {CREDIT_SQL} SELECT Customer_ID, pd, ecl, ecl_ratio, risk_band, decision, ecl2 AS ecl_collateral_aware FROM scoredloans",
    {"pd": 6, "ecl": 4, "ecl_ratio": 6, "ecl_collateral_aware": 4},
)
def _(t):
    return money.score_credit(t.loans).select("Customer_ID", "pd", "ecl", "ecl_ratio", "risk_band", "decision", "ecl_collateral_aware")


@query(
    "risk_band_rollup",
    f"""WITH {CREDIT_SQL} SELECT risk_band, count(*) AS n, avg(pd) AS mean_pd, avg(Default_Flag) AS observed_rate, sum(Loan_Amount) AS exposure, sum(ecl) AS ecl_flat, sum(ecl2) AS ecl_secured
        FROM scoredloans GROUP BY 1""",
    {"mean_pd": 6, "observed_rate": 6, "exposure": 2, "ecl_flat": 2, "ecl_secured": 2},
)
def _(t):
    return money.band_rollup(money.score_credit(t.loans), "pd", "Default_Flag", "Loan_Amount")


@query(
    "segment_rollup",
    f"WITH {CREDIT_SQL} SELECT Segment, count(*) AS n, avg(Interest_Rate) / 100 AS gross_yield, sum(Loan_Amount) AS exposure, sum(ecl) / sum(Loan_Amount) AS ecl_rate FROM scoredloans GROUP BY 1",
    {"gross_yield": 8, "exposure": 2, "ecl_rate": 8},
)
def _(t):
    return money.segment_rollup(money.score_credit(t.loans), "Segment", "Interest_Rate", "Loan_Amount")


@query(
    "fraud_queue",
    """SELECT row_id, CASE WHEN score >= 0.3 THEN 1 ELSE 0 END AS investigate, 0.3 AS threshold, score * 10000 AS expected_cost_if_ignored, 500.0 AS investigation_cost,
       score * 10000 - 500 AS net_benefit_of_investigating, CASE WHEN score <= -0.01 THEN NULL WHEN score <= 0.3 THEN 'monitor' WHEN score <= 0.6 THEN 'review' WHEN score <= 1.01 THEN 'urgent' END AS priority FROM scored""",
    {"threshold": 4, "expected_cost_if_ignored": 4, "investigation_cost": 2, "net_benefit_of_investigating": 4},
)
def _(t):
    return money.score_fraud_queue(t.scored, "score", 0.3).select(
        "row_id", "investigate", "threshold", "expected_cost_if_ignored", "investigation_cost", "net_benefit_of_investigating", "priority")


@query(
    "fraud_drag",
    """SELECT event_type, sum(CASE WHEN score < 0.3 AND label = 1 THEN 10000.0 ELSE 0 END + CASE WHEN score >= 0.3 AND label = 0 THEN 500.0 ELSE 0 END) / sum(value) AS drag FROM scored GROUP BY 1""",
    {"drag": 6},
)
def _(t):
    q = money.score_fraud_queue(t.scored, "score", 0.3)
    cost = F.when((F.col("investigate") == 0) & (F.col("label") == 1), 10000.0).when((F.col("investigate") == 1) & (F.col("label") == 0), 500.0).otherwise(0.0)
    return q.groupBy("event_type").agg((F.sum(cost) / F.sum("value")).alias("drag"))


# ----------------------------------------------------------------------------------------------
# Customers
# ----------------------------------------------------------------------------------------------
@query(
    "lifetime_value",
    "SELECT Customer_ID, Annual_Income * 0.3 * (0.9 / 1.12 + power(0.9, 2) / power(1.12, 2) + power(0.9, 3) / power(1.12, 3)) AS clv FROM customers", {"clv": 4},
)
def _(t):
    return t.customers.select("Customer_ID", money.lifetime_value("Annual_Income").alias("clv"))


PROXY_SQL = """
px AS (SELECT Customer_ID, Estimated_CLV, (rank() OVER (ORDER BY Complaints) + (count(*) OVER (PARTITION BY Complaints) - 1) / 2.0) / count(*) OVER () * 0.6
     + (1 - (rank() OVER (ORDER BY Digital_Usage) + (count(*) OVER (PARTITION BY Digital_Usage) - 1) / 2.0) / count(*) OVER ()) * 0.4 AS churn_p FROM customers)
"""


@query("churn_proxy", f"WITH {PROXY_SQL} SELECT Customer_ID, churn_p FROM px", {"churn_p": 8})
def _(t):
    return money.churn_proxy(t.customers, "Complaints", "Digital_Usage").select("Customer_ID", "churn_p")


@query(
    "customer_prioritisation",
    f"""WITH {PROXY_SQL}, rr AS (SELECT Customer_ID, Estimated_CLV, round(churn_p + @N@, 8) AS churn_p FROM px),
    q AS (SELECT quantile_cont(Estimated_CLV, 0.5) AS v, quantile_cont(churn_p, 0.5) AS c FROM rr),
    z AS (SELECT *, Estimated_CLV * churn_p AS risk FROM rr, q)
    SELECT Customer_ID, CASE WHEN Estimated_CLV >= v AND churn_p >= c THEN 'Priority retention' WHEN Estimated_CLV >= v THEN 'Protect' WHEN churn_p >= c THEN 'Low-cost intervention' ELSE 'Maintain' END AS segment,
      risk AS expected_value_at_risk, row_number() OVER (ORDER BY risk DESC, Customer_ID) AS contact_rank, CASE WHEN row_number() OVER (ORDER BY risk DESC, Customer_ID) <= 1000 THEN 1 ELSE 0 END AS contact FROM z""",
    {"expected_value_at_risk": 4},
)
def _(t):
    from .views import NUDGE

    df = money.churn_proxy(t.customers, "Complaints", "Digital_Usage").withColumn("churn_p", F.round(F.col("churn_p") + NUDGE, 8))
    return money.prioritise(df, "Estimated_CLV", "churn_p", "Customer_ID").select(
        "Customer_ID", "segment", "expected_value_at_risk", "contact_rank", "contact")


@query(
    "contact_list", "SELECT Customer_ID, Estimated_CLV FROM customers ORDER BY Estimated_CLV DESC, Customer_ID LIMIT 100", {"Estimated_CLV": 2},
)
def _(t):
    return money.contact_list(t.customers.select("Customer_ID", "Estimated_CLV"), "Estimated_CLV", "Customer_ID", 100)


# ----------------------------------------------------------------------------------------------
# Liquidity and options
# ----------------------------------------------------------------------------------------------
@query(
    "liquidity_stress",
    """WITH p AS (SELECT Date, Deposits AS d, Wholesale_Funding AS w, Cash + Securities_Holdings AS l, Expected_Outflows AS o FROM liquidity),
    s AS (SELECT 'mild' AS scenario, 0.02 AS r, 0.10 AS h UNION ALL SELECT 'severe', 0.05, 0.25 UNION ALL SELECT 'extreme', 0.10, 0.50)
    SELECT Date, scenario, d * r AS lost_deposits, w * h AS lost_funding, o + d * r + w * h AS stressed_outflows, l - w * h AS surviving_buffer,
      (l - w * h) / (o + d * r + w * h + 1e-12) AS coverage_ratio, CASE WHEN l - w * h >= o + d * r + w * h THEN 1 ELSE 0 END AS survives FROM p, s""",
    {"lost_deposits": 3, "lost_funding": 3, "stressed_outflows": 3, "surviving_buffer": 3, "coverage_ratio": 5},
)
def _(t):
    df = t.liquidity.select(
        "Date", F.col("Deposits").alias("deposits"), F.col("Wholesale_Funding").alias("wholesale_funding"),
        (F.col("Cash") + F.col("Securities_Holdings")).alias("liquid_assets"), F.col("Expected_Outflows").alias("expected_outflows"))
    return money.stress_liquidity(df).select(
        "Date", "scenario", "lost_deposits", "lost_funding", "stressed_outflows", "surviving_buffer", "coverage_ratio", "survives")


OPT = f"""
a AS (SELECT *, greatest(Time_to_Maturity, 1e-8) AS tt, greatest(Volatility, 1e-8) AS sg FROM options),
b AS (SELECT *, (ln(Spot / Strike) + (Interest_Rate + 0.5 * sg * sg) * tt) / (sg * sqrt(tt)) AS d1, Strike * exp(-Interest_Rate * tt) AS k FROM a),
c AS (SELECT *, d1 - sg * sqrt(tt) AS d2, exp(-0.5 * d1 * d1) / {math.sqrt(2 * math.pi)!r} AS pdf FROM b),
n AS (SELECT *, {cdf_sql('d1')} AS n1, {cdf_sql('d2')} AS n2, {cdf_sql('(-d1)')} AS m1, {cdf_sql('(-d2)')} AS m2 FROM c),
val AS (SELECT *, CASE WHEN Option_Type = 'Call' THEN Spot * n1 - k * n2 ELSE k * m2 - Spot * m1 END AS bs FROM n),
gr AS (SELECT *, CASE WHEN Option_Type = 'Call' THEN n1 ELSE n1 - 1 END AS delta, pdf / (Spot * sg * sqrt(tt)) AS gamma, Spot * pdf * sqrt(tt) / 100 AS vega,
   (-(Spot * pdf * sg) / (2 * sqrt(tt)) - CASE WHEN Option_Type = 'Call' THEN Interest_Rate * k * n2 ELSE -Interest_Rate * k * m2 END) / 365 AS theta,
   CASE WHEN Option_Type = 'Call' THEN k * tt * n2 / 100 ELSE -k * tt * m2 / 100 END AS rho FROM val)
"""


@query(
    "option_valuation",
    f"""WITH {OPT} SELECT Option_ID, bs AS bs_recomputed, abs(bs - Black_Scholes_Price) AS bs_check_error, abs(bs - Black_Scholes_Price) / nullif(Black_Scholes_Price, 0) AS bs_check_error_pct,
        Market_Price - Black_Scholes_Price AS mispricing, (Market_Price - Black_Scholes_Price) / nullif(Black_Scholes_Price, 0) AS mispricing_pct FROM val""",
    dict.fromkeys(("bs_recomputed", "bs_check_error", "bs_check_error_pct", "mispricing", "mispricing_pct"), 6),
)
def _(t):
    return money.value_options(t.options).select("Option_ID", "bs_recomputed", "bs_check_error", "bs_check_error_pct", "mispricing", "mispricing_pct")


GREEKS = dict.fromkeys(("delta", "gamma", "vega", "theta", "rho"), 7)


@query("option_greeks", f"WITH {OPT} SELECT Option_ID, delta, gamma, vega, theta, rho FROM gr", GREEKS)
def _(t):
    return money.option_greeks(t.options).select("Option_ID", *GREEKS)


@query(
    "option_book_exposure",
    f"""WITH {OPT} SELECT Underlying, count(*) AS n_contracts, {", ".join(f"sum({g} * position) AS net_{g}" for g in GREEKS)}, sum(delta * position * Spot) AS delta_notional FROM gr GROUP BY 1""",
    {f"net_{g}": 6 for g in GREEKS} | {"delta_notional": 4},
)
def _(t):
    return money.book_exposure(money.option_greeks(t.options), "Underlying", "position")


@query(
    "closed_form_benchmark",
    f"""WITH {OPT}, e AS (SELECT Market_Price AS y, bs - Market_Price AS e FROM val)
        SELECT sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, quantile_cont(abs(e), 0.5) AS medae, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2, avg(e) AS bias, count(*) AS n FROM e""",
    dict.fromkeys(("rmse", "mae", "medae", "r2", "bias"), 6),
)
def _(t):
    from ..operators.metrics import regression_metrics

    return regression_metrics(money.value_options(t.options), "Market_Price", "bs_recomputed")


# ----------------------------------------------------------------------------------------------
# Portfolios
# ----------------------------------------------------------------------------------------------
PM_OUT = dict.fromkeys(("total_return", "annual_return", "annual_volatility", "max_drawdown", "hit_rate"), 6) | dict.fromkeys(("sharpe", "sortino", "calmar"), 4)


@query(
    "portfolio_statistics",
    """WITH e AS (SELECT book, Date, ret, sum(ln(1 + ret)) OVER (PARTITION BY book ORDER BY Date) AS lg FROM book_returns),
    d AS (SELECT *, exp(lg - max(lg) OVER (PARTITION BY book ORDER BY Date)) - 1 AS dd FROM e),
    a AS (SELECT book, exp(sum(ln(1 + ret))) - 1 AS tr, count(*) / 252.0 AS y, stddev_samp(ret) * sqrt(252) AS v, stddev_samp(ret) FILTER (ret < 0) * sqrt(252) AS dv, min(dd) AS md,
       avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS hit_rate, count(*) AS n FROM d GROUP BY book),
    b AS (SELECT *, power(1 + tr, 1 / y) - 1 AS ar FROM a)
    SELECT book, tr AS total_return, ar AS annual_return, v AS annual_volatility, (ar - 0.06) / v AS sharpe, (ar - 0.06) / dv AS sortino, md AS max_drawdown, ar / abs(md) AS calmar, hit_rate, n AS n_periods FROM b""",
    PM_OUT,
)
def _(t):
    return portfolio.portfolio_metrics(t.book_returns, ["book"], "Date", "ret")


@query(
    "equal_weight_returns",
    "SELECT Date, avg(Return) AS portfolio_return, count(Return) AS n_assets FROM market GROUP BY Date", {"portfolio_return": 8},
)
def _(t):
    return portfolio.equal_weight_returns(t.market, "Date", "Return")


REBALANCE = """
cal AS (SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS pos FROM (SELECT DISTINCT Date FROM market)),
reb AS (SELECT max(Date) AS Date, max(pos) AS pos FROM cal GROUP BY date_trunc('month', Date) HAVING max(pos) >= 60),
ent AS (SELECT DISTINCT Ticker FROM market), nn AS (SELECT count(*) AS n FROM ent)
"""


@query("rebalance_calendar", f"WITH {REBALANCE} SELECT Date, pos AS position FROM reb")
def _(t):
    return portfolio.rebalance_calendar(portfolio.calendar(t.market, "Date"), "Date")


SIGNAL = f"""{REBALANCE},
rk AS (SELECT m.Date, Ticker, (rank() OVER (PARTITION BY m.Date ORDER BY Momentum_20D) + (count(*) OVER (PARTITION BY m.Date, Momentum_20D) - 1) / 2.0) / count(*) OVER (PARTITION BY m.Date) AS r,
   count(*) OVER (PARTITION BY m.Date) AS k FROM market m JOIN reb ON m.Date = reb.Date),
sd AS (SELECT *, count(*) FILTER (r >= 0.8) OVER (PARTITION BY Date) AS nl, count(*) FILTER (r <= 0.2) OVER (PARTITION BY Date) AS ns FROM rk WHERE k >= 2),
wts AS (SELECT Date, Ticker, CASE WHEN r <= 0.2 THEN -1.0 / ns WHEN r >= 0.8 THEN 1.0 / nl END AS weight FROM sd WHERE r <= 0.2 OR r >= 0.8)
"""
EQUAL = f"{REBALANCE}, wts AS (SELECT Date, Ticker, 1.0 / n AS weight FROM reb, ent, nn)"
BACKTEST = """
steps AS (SELECT Date, row_number() OVER (ORDER BY Date) AS k FROM (SELECT DISTINCT Date FROM wts)),
grid AS (SELECT s.Date, s.k, Ticker, coalesce(weight, 0) AS w FROM steps s JOIN ent ON true LEFT JOIN wts USING (Date, Ticker)),
mv AS (SELECT Date, abs(w - coalesce(lag(w) OVER (PARTITION BY Ticker ORDER BY k), 1.0 / n)) AS ch FROM grid, nn),
tc AS (SELECT Date, sum(ch) AS turnover, sum(ch) * 10.0 / 10000 AS cost FROM mv GROUP BY Date),
tl AS (SELECT c.Date, turnover, cost, max(tc.Date) OVER (ORDER BY c.Date) AS active FROM cal c LEFT JOIN tc ON c.Date = tc.Date),
pr AS (SELECT m.Date, sum(CASE WHEN active IS NULL THEN 1.0 / n ELSE coalesce(w.weight, 0) END * coalesce(Return, 0)) - max(coalesce(cost, 0)) AS portfolio_return, max(coalesce(turnover, 0)) AS turnover
   FROM market m JOIN tl ON m.Date = tl.Date JOIN nn ON true LEFT JOIN wts w ON w.Date = active AND w.Ticker = m.Ticker GROUP BY m.Date)
"""


def _market(t):
    """The panel is a join and an aggregate; several steps read it, so it is written once."""
    return materialise(t.market.select("Date", "Ticker", "Return", "Momentum_20D"), "market")


def _signal(t, short=0.2):
    m = _market(t)
    dates = portfolio.calendar(m, "Date")
    reb = portfolio.rebalance_calendar(dates, "Date")
    return m, reb, portfolio.signal_weights(m.select("Date", "Ticker", "Momentum_20D"), reb, "Date", "Ticker", "Momentum_20D", short_q=short)


@query("signal_portfolio", f"WITH {SIGNAL} SELECT * FROM wts", {"weight": 8})
def _(t):
    return _signal(t)[2]


@query("turnover_cost", f"WITH {SIGNAL}, {BACKTEST} SELECT * FROM tc", {"turnover": 8, "cost": 10})
def _(t):
    m, _, w = _signal(t)
    return portfolio.turnover(w, m.select("Ticker").distinct(), "Date", "Ticker")


@query("backtest_signal", f"WITH {SIGNAL}, {BACKTEST} SELECT * FROM pr", {"portfolio_return": 8, "turnover": 8})
def _(t):
    m, _, w = _signal(t)
    return portfolio.backtest(m.select("Date", "Ticker", "Return"), w, "Date", "Ticker", "Return")


@query("backtest_equal_weight", f"WITH {EQUAL}, {BACKTEST} SELECT * FROM pr", {"portfolio_return": 8, "turnover": 8})
def _(t):
    m = _market(t)
    reb = portfolio.rebalance_calendar(portfolio.calendar(m, "Date"), "Date")
    w = portfolio.equal_weights(reb, m.select("Ticker").distinct(), "Date", "Ticker")
    return portfolio.backtest(m.select("Date", "Ticker", "Return"), w, "Date", "Ticker", "Return")


@query("mean_variance_weights", None, {"weight": 8})
def _(t):
    m = _market(t).select("Date", "Ticker", "Return")
    dates = portfolio.calendar(m, "Date")
    return portfolio.mean_variance_weights(m, portfolio.rebalance_calendar(dates, "Date"), dates, "Date", "Ticker", "Return")


@query(
    "mean_variance_budget",
    f"WITH {REBALANCE} SELECT Date, 1.0 AS total_weight, true AS long_only FROM reb", {"total_weight": 8},
)
def _(t):
    m = _market(t).select("Date", "Ticker", "Return")
    dates = portfolio.calendar(m, "Date")
    w = portfolio.mean_variance_weights(m, portfolio.rebalance_calendar(dates, "Date"), dates, "Date", "Ticker", "Return")
    return w.groupBy("Date").agg(F.sum("weight").alias("total_weight"), (F.min("weight") >= 0).alias("long_only"))


@query("backtest_mean_variance", None, {"portfolio_return": 8, "turnover": 8})
def _(t):
    m = _market(t).select("Date", "Ticker", "Return")
    dates = portfolio.calendar(m, "Date")
    w = portfolio.mean_variance_weights(m, portfolio.rebalance_calendar(dates, "Date"), dates, "Date", "Ticker", "Return")
    return portfolio.backtest(m, w, "Date", "Ticker", "Return")


@query(
    "panel_alignment",
    """WITH r AS (SELECT CAST(l_shipdate AS DATE) AS Date, l_returnflag AS e, sum(l_extendedprice) AS a FROM lineitem GROUP BY 1, 2),
       s AS (SELECT CAST(l_shipdate AS DATE) AS Date, l_returnflag AS e, avg(l_discount) AS b FROM lineitem GROUP BY 1, 2)
       SELECT e, count(*) AS n, corr(a, b) AS correlation FROM r JOIN s USING (Date, e) GROUP BY e""",
    {"correlation": 6},
)
def _(t):
    day = F.to_date("l_shipdate").alias("Date")
    returns = t.lineitem.groupBy(day, F.col("l_returnflag").alias("e")).agg(F.sum("l_extendedprice").alias("a"))
    signals = t.lineitem.groupBy(day, F.col("l_returnflag").alias("e")).agg(F.avg("l_discount").alias("b"))
    return returns.join(signals, ["Date", "e"]).groupBy("e").agg(F.count(F.lit(1)).alias("n"), scalar.safe_corr("a", "b").alias("correlation"))


# ----------------------------------------------------------------------------------------------
# Market risk
# ----------------------------------------------------------------------------------------------
VAR_SQL = """
q AS (SELECT book, quantile_cont(ret, 0.01) AS c FROM book_returns GROUP BY book),
v AS (SELECT book, -max(c) AS var, -avg(ret) FILTER (ret <= c) AS expected_shortfall, count(*) AS n FROM book_returns JOIN q USING (book) GROUP BY book)
"""


@query("historical_var", f"WITH {VAR_SQL} SELECT * FROM v", {"var": 8, "expected_shortfall": 8})
def _(t):
    return portfolio.historical_risk(t.book_returns, ["book"], "ret", 0.99)


@query(
    "historical_var_null_book",
    """WITH b AS (SELECT CASE WHEN book = 'NO' THEN '(none)' ELSE book END AS g, ret FROM book_returns), q AS (SELECT g, quantile_cont(ret, 0.01) AS c FROM b GROUP BY g)
       SELECT nullif(g, '(none)') AS book, -max(c) AS var, -avg(ret) FILTER (ret <= c) AS expected_shortfall, count(*) AS n FROM b JOIN q USING (g) GROUP BY g""",
    {"var": 8, "expected_shortfall": 8},
)
def _(t):
    return portfolio.historical_risk(t.book_returns.withColumn("book", F.nullif("book", F.lit("NO"))), ["book"], "ret", 0.99)


@query(
    "parametric_var",
    f"SELECT book, -(avg(ret) + {normal.norm_ppf(1 - 0.99)!r} * stddev_samp(ret)) AS var FROM book_returns GROUP BY book", {"var": 8},
)
def _(t):
    return portfolio.parametric_var(t.book_returns, ["book"], "ret", 0.99)


@query(
    "resampled_var",
    """WITH nr AS (SELECT book, ret, row_number() OVER (PARTITION BY book ORDER BY Date) - 1 AS i, count(*) OVER (PARTITION BY book) AS n FROM book_returns),
    d AS (SELECT book, path, CAST(floor(CAST(('0x' || substr(md5(concat_ws(':', book, CAST(path AS VARCHAR), CAST(step AS VARCHAR), '42')), 1, 13)) AS BIGINT) / 4503599627370496 * n) AS BIGINT) AS i
      FROM (SELECT DISTINCT book, n FROM nr), (SELECT unnest(range(10000)) AS path), (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    s AS (SELECT book, path, sum(ret) AS total FROM d JOIN nr USING (book, i) GROUP BY book, path)
    SELECT book, -quantile_cont(total, 0.01) AS var FROM s GROUP BY book""",
    {"var": 8},
)
def _(t):
    return portfolio.resampled_var(t.book_returns, ["book"], ["Date"], "ret", 0.99, horizon=5)


@query(
    "var_backtest",
    f"""WITH {VAR_SQL}, k AS (SELECT book, CAST(count(*) FILTER (ret < -var) AS BIGINT) AS exceptions, count(*) AS n_observations FROM book_returns JOIN v USING (book) GROUP BY book),
    l AS (SELECT *, exceptions / n_observations AS observed_rate, -2.0 * (exceptions * {math.log(1 - 0.99)!r} + (n_observations - exceptions) * {math.log(1 - (1 - 0.99))!r}
        - coalesce(exceptions * ln(nullif(exceptions, 0) / n_observations), 0) - coalesce((n_observations - exceptions) * ln(nullif(n_observations - exceptions, 0) / n_observations), 0)) AS lr_statistic FROM k)
    SELECT book, exceptions, n_observations, lr_statistic, 2 * {cdf_sql(f'(-(sqrt(greatest(lr_statistic, 0) / 2) * {math.sqrt(2.0)!r}))')} AS p_value, observed_rate, {1 - 0.99!r} AS expected_rate FROM l""",
    {"lr_statistic": 6, "p_value": 6, "observed_rate": 8, "expected_rate": 8},
)
def _(t):
    limits = portfolio.historical_risk(t.book_returns, ["book"], "ret", 0.99)
    return portfolio.var_backtest(t.book_returns, limits, ["book"], "ret", 0.99)


# ----------------------------------------------------------------------------------------------
# Allocation
# ----------------------------------------------------------------------------------------------
def _measured(t):
    loans = money.score_credit(t.loans)
    nations = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    owner = t.orders.select(F.col("o_orderkey").alias("Customer_ID"), F.col("o_custkey").alias("k")).join(nations, "k").drop("k")
    seg = money.segment_rollup(loans.join(owner, "Customer_ID").withColumn("key", F.struct("nation", "Customer_Type")), "key", "Interest_Rate", "Loan_Amount")
    return allocation.measured_lending(seg.select("key.*", "gross_yield", "ecl_rate"), ["nation"])


INPUT_OUT = dict.fromkeys(("expected_return", "volatility", "loss_rate", "low", "high", "net_return"), 8) | {"risk_adjusted_return": 5}
DEFAULTS = ", ".join(f"('{b}', {r}, {v}, {d}, {lo}, {min(hi, cap / 1000.0) if cap else hi})" for b, r, v, d, lo, hi, cap in allocation.specs.BUCKET_DEFAULTS)
INPUTS = f"""
{CREDIT_SQL}, seg AS (SELECT c_nationkey AS nation, CASE WHEN Customer_Type = 'Corporate' THEN 'corporate_lending' ELSE 'retail_lending' END AS bucket, avg(Interest_Rate) / 100 AS y, sum(ecl) / sum(Loan_Amount) AS e
   FROM scoredloans JOIN orders ON Customer_ID = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
df AS (SELECT * FROM (VALUES {DEFAULTS}) x(bucket, er, vo, lr, lo, hi)),
inp AS (SELECT n.nation, df.bucket, CAST(coalesce(y, er) AS DOUBLE) AS expected_return, CAST(vo AS DOUBLE) AS volatility, CAST(coalesce(e, lr) AS DOUBLE) AS loss_rate, CAST(lo AS DOUBLE) AS low, CAST(hi AS DOUBLE) AS high, y IS NULL AND e IS NULL AS is_placeholder
   FROM (SELECT DISTINCT nation FROM seg) n JOIN df ON true LEFT JOIN seg ON seg.nation = n.nation AND seg.bucket = df.bucket)
"""


@query(
    "allocation_inputs",
    f"WITH {INPUTS} SELECT *, expected_return - loss_rate AS net_return, (expected_return - loss_rate) / (volatility + 1e-9) AS risk_adjusted_return FROM inp", INPUT_OUT,
)
def _(t):
    return allocation.bucket_inputs(_measured(t), "nation")


ALLOC_OUT = dict.fromkeys(("risk_aversion", "effective_risk_aversion", "portfolio_risk", "allocation_pct", "low", "high"), 6) | dict.fromkeys(
    ("allocation_crore", "expected_profit_crore", "expected_loss_crore"), 4)


SOLVE = """
lam AS (SELECT nation, rr, k, rr * power(1.5, k) AS lam FROM (SELECT DISTINCT nation FROM inp), (SELECT unnest({scenarios}) AS rr), (SELECT unnest(range(41)) AS k)),
bb AS (SELECT lam.*, bucket, net, volatility * volatility AS v, low, high, loss_rate FROM lam JOIN (SELECT *, expected_return - loss_rate AS net FROM inp) i ON lam.nation = i.nation),
co AS (SELECT nation, rr, k, net - lam * v * high AS nu FROM bb UNION ALL SELECT nation, rr, k, net - lam * v * low FROM bb),
tt AS (SELECT c.nation, c.rr, c.k, c.nu, sum(least(greatest((net - c.nu) / (lam * v), low), high)) AS total FROM co c JOIN bb b ON c.nation = b.nation AND c.rr = b.rr AND c.k = b.k
   GROUP BY c.nation, c.rr, c.k, c.nu),
nu AS (SELECT nation, rr, k, max(nu) FILTER (total >= 1) AS n0, arg_max(total, nu) FILTER (total >= 1) AS t0, min(nu) FILTER (total < 1) AS n1, arg_min(total, nu) FILTER (total < 1) AS t1 FROM tt GROUP BY nation, rr, k),
ww AS (SELECT b.*, least(greatest((net - CASE WHEN n1 IS NULL THEN n0 WHEN n0 IS NULL THEN n1 ELSE n0 + (t0 - 1) / (t0 - t1) * (n1 - n0) END) / (lam * v), low), high) AS w FROM bb b JOIN nu USING (nation, rr, k)),
rk AS (SELECT nation, rr, k, sqrt(sum(w * w * v)) AS risk FROM ww GROUP BY nation, rr, k),
ch AS (SELECT nation, rr, coalesce(min(k) FILTER (risk <= 0.08), 40) AS k FROM rk GROUP BY nation, rr),
plan AS (SELECT ww.nation, ww.rr AS risk_aversion, lam AS effective_risk_aversion, risk AS portfolio_risk, bucket, w AS allocation_pct, w * 1000 AS allocation_crore, w * 1000 * net AS expected_profit_crore,
   w * 1000 * loss_rate AS expected_loss_crore, low, high FROM ww JOIN ch USING (nation, rr, k) JOIN rk USING (nation, rr, k))
"""


@query("allocation_sweep", f"WITH {INPUTS}, {SOLVE.format(scenarios='[1.0::DOUBLE, 2.0, 5.0, 10.0]')} SELECT * FROM plan", ALLOC_OUT)
def _(t):
    return allocation.allocate(allocation.bucket_inputs(_measured(t), "nation"), "nation", [1.0, 2.0, 5.0, 10.0])


@query(
    "allocation_binding",
    f"""WITH {INPUTS}, {SOLVE.format(scenarios='[2.0::DOUBLE]')} SELECT *, CASE WHEN abs(allocation_pct - low) < 1e-4 AND low > 0 THEN 'MINIMUM'
        WHEN abs(allocation_pct - high) < 1e-4 AND high < 1 THEN 'MAXIMUM' ELSE 'free' END AS binding FROM plan""",
    ALLOC_OUT,
)
def _(t):
    return allocation.binding_constraints(allocation.allocate(allocation.bucket_inputs(_measured(t), "nation"), "nation", [2.0]))


@query(
    "allocation_summary",
    f"""WITH {INPUTS}, {SOLVE.format(scenarios='[1.0::DOUBLE, 2.0, 5.0]')} SELECT nation, risk_aversion, sum(allocation_pct) AS total_weight, sum(expected_profit_crore) / 1000 AS portfolio_return,
        max(portfolio_risk) AS portfolio_risk, sum(expected_profit_crore) AS expected_profit_crore, sum(expected_loss_crore) AS expected_loss_crore FROM plan GROUP BY 1, 2""",
    {"risk_aversion": 2, "total_weight": 8, "portfolio_return": 8, "portfolio_risk": 8, "expected_profit_crore": 4, "expected_loss_crore": 4},
)
def _(t):
    plan = allocation.allocate(allocation.bucket_inputs(_measured(t), "nation"), "nation", [1.0, 2.0, 5.0])
    return allocation.allocation_summary(plan, ["nation", "risk_aversion"])


@query(
    "fraud_queue_stream",
    """SELECT event_id, CASE WHEN p >= 0.3 THEN 1 ELSE 0 END AS investigate, p * 10000 - 500 AS net_benefit_of_investigating,
       CASE WHEN p <= -0.01 THEN NULL WHEN p <= 0.3 THEN 'monitor' WHEN p <= 0.6 THEN 'review' WHEN p <= 1.01 THEN 'urgent' END AS priority FROM (SELECT event_id, @U(event_id,11)@ AS p FROM events)""",
    {"net_benefit_of_investigating": 4},
)
def _(t):
    arrivals = scoring.read_arrivals(t.spark, t.sf_dir, t.events.schema, "events.parquet")
    scored = scoring.decide(arrivals, lambda df: money.score_fraud_queue(df.withColumn("p", scalar.uniform("event_id", 11)), "p", 0.3))
    sink, state = fresh_dir(t.spark, "decisions"), fresh_dir(t.spark, "decisions-state")
    scoring.run_to_date(scored.select("event_id", "investigate", "net_benefit_of_investigating", "priority"), sink, state)
    return t.spark.read.parquet(sink)
