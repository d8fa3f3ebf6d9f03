"""Scores and cash flows turned into money and decisions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import band
from ..functions.normal import norm_cdf, norm_pdf
from ..functions.scalar import col, flag, present_cash_flow, safe_div
from ..session import materialise
from ..sources import specs
from .ordered import average_ranks, column_quantiles, row_position


# ----------------------------------------------------------------------------------------------
# Projects
# ----------------------------------------------------------------------------------------------
def npv(flows: list, rate: float, investment) -> Column:
    """Net present value with flows at the end of each year."""
    return present_cash_flow(flows, rate) - col(investment)


def profitability_index(flows: list, rate: float, investment) -> Column:
    return safe_div(present_cash_flow(flows, rate), investment)


def expected_npv(value, probability, recovery: float = 0.0) -> Column:
    return col(probability) * col(value) + (1 - col(probability)) * F.lit(recovery)


def irr(flows: list, investment, low: float = -0.99, high: float = 10.0, steps: int = 100, margin: float = 0.01) -> Column:
    """Rate at which the present value is zero, by halving an interval, for a batch of rows at once.

    A middle that is a root itself stays in the interval. NULL without a sign change, and for the meaningless root next to the lower bound.
    """

    @F.pandas_udf("double")
    def solved(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            paid, *gained = [c.to_numpy("float64", na_value=np.nan) for c in columns]
            with np.errstate(all="ignore"):
                yield pd.Series(_halved(gained, paid, low, high, steps, margin))

    return solved(*[col(x).cast("double") for x in [investment, *flows]])


def _halved(flows: list[np.ndarray], investment: np.ndarray, low: float, high: float, steps: int, margin: float) -> np.ndarray:
    def value(rate: np.ndarray) -> np.ndarray:
        return sum(x / np.power(1 + rate, float(t)) for t, x in enumerate(flows, start=1)) - investment

    lo, hi = np.full(len(investment), low), np.full(len(investment), high)
    at_lo = value(lo)
    brackets = at_lo * value(hi) <= 0
    for _ in range(steps):
        middle = (lo + hi) / 2
        if not ((middle != lo) & (middle != hi) & brackets).any():
            break  # no number lies between the ends any more
        at_middle = value(middle)
        inside = at_lo * at_middle <= 0
        lo, at_lo, hi = np.where(inside, lo, middle), np.where(inside, at_lo, at_middle), np.where(inside, middle, hi)
    root = (lo + hi) / 2
    return np.where(brackets & (root > low + margin), root, np.nan)


def fund_decision(
    value, risk_rating=None, threshold: float = specs.FUND_THRESHOLD, review_from: float = specs.REVIEW_BAND[0],
    penalty: float = specs.HIGH_RISK_PENALTY,
) -> Column:
    """Fund, Review or Reject; a high-risk project has to clear a higher bar."""
    value, bar = col(value), F.lit(float(threshold))
    if risk_rating is not None:
        raised = F.lit(float(threshold + abs(threshold) * penalty + penalty))
        bar = F.when(F.lower(col(risk_rating)) == "high", raised).otherwise(bar)
    return F.when(value > bar, "Fund").when(value >= review_from, "Review").otherwise("Reject")


# ----------------------------------------------------------------------------------------------
# Credit
# ----------------------------------------------------------------------------------------------
def expected_credit_loss(pd, exposure, lgd: float = specs.LGD, collateral=None) -> Column:
    """Probability x loss share x exposure; with collateral the loss share is what it leaves open."""
    share = F.lit(lgd)
    if collateral is not None:
        open_share = 1 - safe_div(collateral, exposure)
        share = F.when(open_share.isNotNull(), F.least(F.greatest(open_share, F.lit(0.0)), F.lit(1.0)))
    return col(pd) * share * col(exposure)


def risk_band(pd) -> Column:
    return band(pd, specs.PD_BAND_EDGES, specs.PD_BAND_LABELS, closed="left", default=specs.PD_BAND_DEFAULT)


def credit_decision(pd, ecl, exposure, coverage=None) -> Column:
    """Approve, Review or Reject from PD, loss ratio and collateral cover."""
    pd, ratio = col(pd), safe_div(ecl, exposure)
    known = lambda c: F.coalesce(c, F.lit(False))
    decision = (
        F.when(known((pd < specs.APPROVE_PD) & (ratio < specs.MAX_ECL_RATIO)), "Approve")
        .when(known(pd >= specs.REJECT_PD) | known(ratio >= specs.MAX_ECL_RATIO * 2), "Reject")
        .otherwise("Review"))
    if coverage is None:
        return decision
    upgrade = (decision == "Review") & known(col(coverage) >= specs.UPGRADE_COVERAGE) & known(pd < specs.REJECT_PD)
    return F.when(upgrade, "Approve").otherwise(decision)


def score_credit(df: DataFrame, pd: str = "pd", exposure: str = "Loan_Amount", collateral: str | None = "Collateral_Value", lgd: float = specs.LGD) -> DataFrame:
    """PD to expected loss, band and decision for every application."""
    df = df.withColumn("ecl", expected_credit_loss(pd, exposure, lgd))
    cover = safe_div(collateral, exposure) if collateral else None
    return df.withColumns({
        "ecl_ratio": safe_div("ecl", exposure),
        "risk_band": risk_band(pd),
        "decision": credit_decision(pd, "ecl", exposure, cover),
        "ecl_collateral_aware": expected_credit_loss(pd, exposure, collateral=collateral) if collateral else F.col("ecl"),
        "lgd_assumption": F.lit(lgd),
    })


def band_rollup(scored: DataFrame, pd: str, label: str, exposure: str) -> DataFrame:
    """Rows, mean PD, observed rate, exposure and both losses per risk band."""
    return scored.groupBy("risk_band").agg(
        F.count(F.lit(1)).alias("n"), F.avg(pd).alias("mean_pd"), F.avg(label).alias("observed_rate"), F.sum(exposure).alias("exposure"),
        F.sum("ecl").alias("ecl_flat"), F.sum("ecl_collateral_aware").alias("ecl_secured"))


def segment_rollup(scored: DataFrame, segment: str, rate: str, exposure: str) -> DataFrame:
    """Yield and loss rate per segment, as the allocation needs them."""
    return scored.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(rate) / 100).alias("gross_yield"), F.sum(exposure).alias("exposure"),
        safe_div(F.sum("ecl"), F.sum(exposure)).alias("ecl_rate"))


# ----------------------------------------------------------------------------------------------
# Fraud
# ----------------------------------------------------------------------------------------------
def score_fraud_queue(
    df: DataFrame, probability: str, threshold: float = 0.5, cost_missed: float = specs.COST_MISSED_FRAUD, cost_check: float = specs.COST_FALSE_POSITIVE,
) -> DataFrame:
    """What to investigate and what it is worth; row-wise, so it runs on streams as well."""
    p = F.col(probability)
    urgent = min(threshold * 2, 0.99)
    return df.withColumns({
        "investigate": flag(p >= threshold),
        "threshold": F.lit(float(threshold)),
        "expected_cost_if_ignored": p * cost_missed,
        "investigation_cost": F.lit(float(cost_check)),
        "net_benefit_of_investigating": p * cost_missed - cost_check,
        "priority": band(p, [-0.01, threshold, urgent, 1.01], ["monitor", "review", "urgent"]),
    })


# ----------------------------------------------------------------------------------------------
# Customers
# ----------------------------------------------------------------------------------------------
def lifetime_value(
    revenue, retention=specs.CLV_RETENTION, discount: float = specs.DISCOUNT_RATE, years: int = specs.CLV_HORIZON_YEARS, margin: float = specs.CLV_MARGIN,
) -> Column:
    """Discounted margin of a customer over a finite number of years: a geometric sum in q = retention / (1 + discount)."""
    q = (F.lit(float(retention)) if isinstance(retention, (int, float)) else col(retention)) / F.lit(1.0 + discount)
    terms = F.when(F.abs(q - 1) < 1e-12, F.lit(float(years))).otherwise(F.try_divide(q * (1 - F.pow(q, F.lit(float(years)))), 1 - q))
    return col(revenue) * margin * terms


def churn_proxy(df: DataFrame, complaints: str, engagement: str, name: str = "churn_p") -> DataFrame:
    """Value-based stand-in for a churn score from two population ranks."""
    df = average_ranks(materialise(df, "churn"), [], {"_rc": complaints, "_re": engagement})
    return df.withColumn(name, F.col("_rc") * 0.6 + (1 - F.col("_re")) * 0.4).drop("_rc", "_re")


#: By (below, above) the value cut, then by (below, above) the churn cut.
SEGMENT_NAMES = ("Maintain", "Low-cost intervention", "Protect", "Priority retention")


def prioritise(df: DataFrame, value: str, churn: str, key: str, budget: int = specs.CONTACT_BUDGET, value_q: float = 0.5, churn_q: float = 0.5) -> DataFrame:
    """Two-by-two segments around quantiles, value at risk and the contact list."""
    df = materialise(df, "prioritise")
    cuts = column_quantiles(df, [value, churn], sorted({value_q, churn_q}))
    at = {q: k for k, q in enumerate(sorted({value_q, churn_q}))}
    above = lambda c, q: flag(F.col(c) >= F.lit(cuts[c][at[q]] if cuts[c] else None))
    df = df.withColumns({
        "segment": F.element_at(F.array(*[F.lit(s) for s in SEGMENT_NAMES]), 1 + 2 * above(value, value_q) + above(churn, churn_q)),
        "expected_value_at_risk": F.col(value) * F.col(churn),
    })
    # Positions travel with the rows; those without a value come last in falling order and are not ranked.
    known = F.col("expected_value_at_risk").isNotNull()
    ranked = row_position(df.filter(known), ["expected_value_at_risk", key], "_at", descending=True).unionByName(df.filter(~known).withColumn("_at", F.lit(None).cast("bigint")))
    return ranked.withColumn("contact_rank", F.col("_at") + 1).drop("_at").withColumn("contact", flag(F.col("contact_rank") <= budget))


def contact_list(df: DataFrame, score: str, key: str, budget: int) -> DataFrame:
    """The rows with the highest score; only the list itself is ordered."""
    return df.orderBy(F.col(score).desc_nulls_last(), key).limit(budget)


# ----------------------------------------------------------------------------------------------
# Liquidity
# ----------------------------------------------------------------------------------------------
def stress_liquidity(df: DataFrame, scenarios: dict[str, tuple[float, float]] = specs.STRESS_SCENARIOS) -> DataFrame:
    """Positions under joint deposit run-off and funding haircut; one row per position and scenario."""
    cases = F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.lit(r).alias("deposit_runoff"), F.lit(h).alias("funding_haircut")) for n, (r, h) in scenarios.items()])
    df = df.withColumn("_s", F.explode(cases)).select("*", "_s.*").drop("_s")
    df = df.withColumns({
        "lost_deposits": F.col("deposits") * F.col("deposit_runoff"),
        "lost_funding": F.col("wholesale_funding") * F.col("funding_haircut"),
    })
    df = df.withColumns({
        "stressed_outflows": F.col("expected_outflows") + F.col("lost_deposits") + F.col("lost_funding"),
        "surviving_buffer": F.col("liquid_assets") - F.col("lost_funding"),
    })
    return df.withColumns({
        "coverage_ratio": F.col("surviving_buffer") / (F.col("stressed_outflows") + F.lit(1e-12)),
        "survives": flag(F.col("surviving_buffer") >= F.col("stressed_outflows")),
    })


# ----------------------------------------------------------------------------------------------
# Options
# ----------------------------------------------------------------------------------------------
def _d1_d2() -> tuple[Column, Column, Column, Column]:
    t = F.greatest(F.col("Time_to_Maturity"), F.lit(1e-8))
    sigma = F.greatest(F.col("Volatility"), F.lit(1e-8))
    spread = sigma * F.sqrt(t)
    d1 = (F.ln(F.col("Spot") / F.col("Strike")) + (F.col("Interest_Rate") + 0.5 * sigma * sigma) * t) / spread
    return d1, d1 - spread, t, sigma


def value_options(df: DataFrame) -> DataFrame:
    """Closed-form value of every contract and its distance to the supplied and the market price."""
    d1, d2, t, _ = _d1_d2()
    df = df.withColumns({
        "_d1": d1, "_d2": d2, "_k": F.col("Strike") * F.exp(-F.col("Interest_Rate") * t),
        "_side": F.when(F.col("Option_Type") == "Call", F.lit(1.0)).otherwise(F.lit(-1.0)),
    })
    # A put is the call with every sign turned.
    side = F.col("_side")
    value = side * (F.col("Spot") * norm_cdf(side * F.col("_d1")) - F.col("_k") * norm_cdf(side * F.col("_d2")))
    df = df.withColumn("bs_recomputed", value).drop("_d1", "_d2", "_k", "_side")
    df = df.withColumn("bs_check_error", F.abs(F.col("bs_recomputed") - F.col("Black_Scholes_Price")))
    return df.withColumns({
        "bs_check_error_pct": safe_div("bs_check_error", "Black_Scholes_Price"),
        "mispricing": F.col("Market_Price") - F.col("Black_Scholes_Price"),
        "mispricing_pct": safe_div(F.col("Market_Price") - F.col("Black_Scholes_Price"), "Black_Scholes_Price"),
    })


def option_greeks(df: DataFrame) -> DataFrame:
    """Sensitivities of every contract: vega and rho per point, theta per calendar day."""
    d1, d2, t, sigma = _d1_d2()
    df = df.withColumns({
        "_d1": d1, "_d2": d2, "_pdf": norm_pdf(d1), "_k": F.col("Strike") * F.exp(-F.col("Interest_Rate") * t),
        "_side": F.when(F.col("Option_Type") == "Call", F.lit(1.0)).otherwise(F.lit(-1.0)),
    })
    spot, rate, root, side = F.col("Spot"), F.col("Interest_Rate"), F.sqrt(t), F.col("_side")
    df = df.withColumn("_leg", side * norm_cdf(side * F.col("_d2")))
    decay = -(spot * F.col("_pdf") * sigma) / (2 * root)
    return df.withColumns({
        "delta": side * norm_cdf(side * F.col("_d1")),
        "gamma": F.col("_pdf") / (spot * sigma * root),
        "vega": spot * F.col("_pdf") * root / 100,
        "theta": (decay - rate * F.col("_k") * F.col("_leg")) / 365,
        "rho": F.col("_k") * t * F.col("_leg") / 100,
    }).drop("_d1", "_d2", "_pdf", "_k", "_side", "_leg")


def book_exposure(greeks: DataFrame, underlying: str, position: str) -> DataFrame:
    """Position-weighted sensitivities per underlying."""
    names = ["delta", "gamma", "vega", "theta", "rho"]
    return greeks.groupBy(underlying).agg(
        F.count(F.lit(1)).alias("n_contracts"), *[F.sum(F.col(n) * F.col(position)).alias(f"net_{n}") for n in names],
        F.sum(F.col("delta") * F.col(position) * F.col("Spot")).alias("delta_notional"))


