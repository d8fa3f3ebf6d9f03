"""Portfolio weights, backtests and market risk on long (date, entity, value) panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import norm_ppf
from ..functions.scalar import matched, uniform, with_scalars
from ..sources import specs
from .metrics import kupiec
from .ordered import average_ranks, causal, group_quantiles, one_row_per_day, prior_count, row_position, running


# ----------------------------------------------------------------------------------------------
# Statistics of return series
# ----------------------------------------------------------------------------------------------
def portfolio_metrics(
    returns: DataFrame, by: list[str], date: str, value: str, risk_free: float = specs.RISK_FREE_RATE, periods: int = specs.TRADING_DAYS,
) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, drawdown, Calmar and hit rate of each series."""
    r = F.col(value)
    df = returns.filter(r.isNotNull()).withColumn("_g", F.when(r > -1, F.log1p(r)))
    # Several rows of one date are taken in the order of their values.
    df = causal(df, by, [date, value], {"_log": running("_g", "sum")})
    df = causal(df, by, [date, value], {"_peak": running("_log", "max")})
    loss = F.when(r < 0, r)
    agg = df.groupBy(*by).agg(
        (F.exp(F.sum("_g")) - 1).alias("total_return"), (F.count(F.lit(1)) / F.lit(float(periods))).alias("_years"),
        (F.stddev_samp(value) * F.sqrt(F.lit(float(periods)))).alias("annual_volatility"),
        F.when(F.count(loss) > 1, F.stddev_samp(loss) * F.sqrt(F.lit(float(periods)))).alias("_down"),
        F.min(F.exp(F.col("_log") - F.col("_peak")) - 1).alias("max_drawdown"), F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.count(F.lit(1)).alias("n_periods"))
    agg = agg.withColumn("annual_return", F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), 1 / F.col("_years")) - 1))
    excess = F.col("annual_return") - risk_free
    return agg.select(
        *by, "total_return", "annual_return", "annual_volatility",
        F.when(F.col("annual_volatility") > 0, excess / F.col("annual_volatility")).alias("sharpe"),
        F.when(F.col("_down") > 0, excess / F.col("_down")).alias("sortino"), "max_drawdown",
        F.when(F.col("max_drawdown") < 0, F.col("annual_return") / F.abs("max_drawdown")).alias("calmar"), "hit_rate", "n_periods")


def equal_weight_returns(panel: DataFrame, date: str, value: str) -> DataFrame:
    return panel.groupBy(date).agg(F.avg(value).alias("portfolio_return"), F.count(value).alias("n_assets"))


# ----------------------------------------------------------------------------------------------
# Weights
# ----------------------------------------------------------------------------------------------
def calendar(panel: DataFrame, date: str) -> DataFrame:
    """Distinct dates with their 0-based position."""
    return row_position(panel.select(date).distinct(), [date], "position")


def rebalance_calendar(dates: DataFrame, date: str, lookback: int = 60) -> DataFrame:
    """Last available date of each month that has at least ``lookback`` dates before it."""
    last = dates.groupBy(F.date_trunc("month", F.col(date)).alias("_m")).agg(F.max_by(F.struct(date, "position"), date).alias("x"))
    return last.select(f"x.{date}", "x.position").filter(F.col("position") >= lookback)


def equal_weights(rebalances: DataFrame, entities: DataFrame, date: str, entity: str) -> DataFrame:
    """1/N on every rebalance date; the dates, one a month, travel to the entities."""
    n = entities.agg(F.count(F.lit(1)).alias("_n"))
    spread = with_scalars(with_scalars(entities.select(entity), n), rebalances.agg(F.collect_set(date).alias("_d")))
    return spread.select(F.explode("_d").alias(date), entity, (1 / F.col("_n")).alias("weight"))


def signal_weights(
    signals: DataFrame, rebalances: DataFrame, date: str, entity: str, score: str, long_q: float = specs.LONG_QUANTILE, short_q: float = 0.0,
) -> DataFrame:
    """Equal weight in the top share of the signal, optionally short the bottom share.

    A date with fewer than two scores gives no rows: the weights before it stay in force.
    """
    on = signals.join(F.broadcast(rebalances.select(date)), date, "left_semi").filter(F.col(score).isNotNull())  # one date per month
    ranked = average_ranks(on.select(date, entity, score), [date], {"_r": score}, probe=signals.select(date))
    sided = ranked.withColumn("_long", F.col("_r") >= 1 - long_q).withColumn("_short", F.lit(short_q > 0) & (F.col("_r") <= short_q))
    counts = sided.groupBy(date).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_long").alias("_nl"), F.count_if("_short").alias("_ns")).filter("_n >= 2")
    weight = F.when(F.col("_short"), -1 / F.col("_ns")).when(F.col("_long"), 1 / F.col("_nl"))
    return sided.join(F.broadcast(counts), date).select(date, entity, weight.alias("weight")).filter("weight IS NOT NULL")


def mean_variance_weights(
    panel: DataFrame, rebalances: DataFrame, dates: DataFrame, date: str, entity: str, value: str, lookback: int = 60,
    risk_aversion: float = 1.0, shrinkage: float = 0.1, long_only: bool = True,
) -> DataFrame:
    """Mean-variance weights from the ``lookback`` dates before each rebalance.

    Rebalances are independent groups of at most lookback x entities rows; only solving the small
    linear system of one of them happens in Python.
    """
    import numpy as np
    import pandas as pd

    ahead = F.explode(F.sequence(F.col("position") + 1, F.col("position") + lookback)).alias("_at")
    windows = dates.select(F.col(date).alias("_d"), ahead).join(
        rebalances.select(F.col(date).alias("rebalance"), F.col("position").alias("_at")), "_at").select("rebalance", "_d")
    rows = panel.join(F.broadcast(windows), F.col(date) == F.col("_d")).select(  # lookback rows per month of the calendar
        "rebalance", F.col(date).alias("d"), F.col(entity).alias("e"), F.col(value).cast("double").alias("v"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="d", columns="e", values="v").sort_index()
        mu, sigma = wide.mean(), wide.cov()
        known = mu.notna().to_numpy() & np.isfinite(np.diag(sigma.to_numpy()))
        names, m, s = wide.columns[known], mu.to_numpy()[known], np.nan_to_num(sigma.to_numpy()[np.ix_(known, known)])
        n = len(names)
        s = (1 - shrinkage) * s + shrinkage * np.diag(np.diag(s)) + np.eye(n) * 1e-8
        try:
            w = np.linalg.solve(s, m) / risk_aversion
        except np.linalg.LinAlgError:
            w = np.ones(n)
        w = np.clip(w, 0, None) if long_only else w
        w = w / w.sum() if abs(w.sum()) > 1e-12 else np.full(n, 1.0 / max(n, 1))
        return pd.DataFrame({"rebalance": pdf["rebalance"].iloc[0], "e": names, "weight": w})

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    solved = rows.groupBy("rebalance").applyInPandas(solve, f"rebalance {kind['rebalance']}, e {kind['e']}, weight double")
    return solved.select(F.col("rebalance").alias(date), F.col("e").alias(entity), "weight")


# ----------------------------------------------------------------------------------------------
# Backtest
# ----------------------------------------------------------------------------------------------
def turnover(weights: DataFrame, entities: DataFrame, date: str, entity: str, cost_bps: float = specs.TRANSACTION_COST_BPS) -> DataFrame:
    """Sum of absolute weight changes against the previous rebalance; the first one starts from 1/N.

    A weight is bought on its own rebalance and sold on the next one, so changes are sums of these
    two legs and no table of dates by entities has to be filled.
    """
    steps = F.broadcast(calendar(weights, date).withColumnRenamed("position", "_k"))  # one row per rebalance
    bought = weights.join(steps, date).select("_k", entity, "weight")
    sold = bought.select((F.col("_k") + 1).alias("_k"), entity, (-F.col("weight")).alias("weight"))
    n = entities.agg(F.count(F.lit(1)).alias("_n"))
    start = with_scalars(entities.select(entity), n).select(F.lit(0).cast("bigint").alias("_k"), entity, (-1 / F.col("_n")).alias("weight"))
    legs = bought.unionByName(sold).unionByName(start)
    out = legs.groupBy("_k", entity).agg(F.sum("weight").alias("_w")).groupBy("_k").agg(F.sum(F.abs("_w")).alias("turnover"))
    return out.join(steps, "_k").select(date, "turnover", (F.col("turnover") * F.lit(cost_bps / 10000)).alias("cost"))


def backtest(
    panel: DataFrame, weights: DataFrame, date: str, entity: str, value: str, cost_bps: float = specs.TRANSACTION_COST_BPS,
    execution_lag: int = 0,
) -> DataFrame:
    """Daily return after costs of weights that hold from one rebalance to the next.

    Until the first rebalance the portfolio is 1/N.  ``execution_lag`` is the number of dates
    between forming weights and earning with them; costs fall on the date the weights take effect.
    """
    entities = panel.select(entity).distinct()
    n = entities.agg(F.count(F.lit(1)).alias("_n"))
    dates = calendar(panel, date)
    costs = turnover(weights, entities, date, entity, cost_bps)
    effective = costs.join(dates, date).select(F.col(date).alias("_formed"), (F.col("position") + execution_lag).alias("position"), "turnover", "cost")
    timeline = causal(dates.join(effective, "position", "left"), [], [date], {"_active": running("_formed", "max")}, bounded=one_row_per_day(panel, date))
    rows = panel.select(date, entity, F.coalesce(F.col(value), F.lit(0.0)).alias("_r")).join(F.broadcast(timeline), date)  # one row per date
    held = rows.join(
        weights.select(F.col(date).alias("_active"), F.col(entity).alias(entity), "weight"), ["_active", entity], "left")
    held = with_scalars(held, n)
    w = F.when(F.col("_active").isNull(), 1 / F.col("_n")).otherwise(F.coalesce("weight", F.lit(0.0)))
    return held.groupBy(date).agg(
        (F.sum(w * F.col("_r")) - F.max(F.coalesce("cost", F.lit(0.0)))).alias("portfolio_return"),
        F.max(F.coalesce("turnover", F.lit(0.0))).alias("turnover"))


# ----------------------------------------------------------------------------------------------
# Market risk
# ----------------------------------------------------------------------------------------------
def historical_risk(returns: DataFrame, by: list[str], value: str, confidence: float = 0.99) -> DataFrame:
    """Empirical value at risk and expected shortfall per series, as positive losses."""
    cut = group_quantiles(returns, by, value, {"_cut": round(1 - confidence, 12)})
    rows = returns.filter(F.col(value).isNotNull())
    joined = matched(rows, cut, by) if by else with_scalars(rows, cut)
    return joined.groupBy(*by).agg(
        (-F.max("_cut")).alias("var"), (-F.avg(F.when(F.col(value) <= F.col("_cut"), F.col(value)))).alias("expected_shortfall"),
        F.count(F.lit(1)).alias("n"))


def parametric_var(returns: DataFrame, by: list[str], value: str, confidence: float = 0.99) -> DataFrame:
    """Normal value at risk per series."""
    z = norm_ppf(1 - confidence)
    return returns.groupBy(*by).agg((-(F.avg(value) + F.lit(z) * F.stddev_samp(value))).alias("var"))


def resampled_var(
    returns: DataFrame, by: list[str], order: list[str], value: str, confidence: float = 0.99, paths: int = specs.VAR_PATHS,
    horizon: int = 1, seed: int = 42,
) -> DataFrame:
    """Value at risk of horizon sums drawn from the observed returns of each series.

    Returns are numbered; a draw is a number, so sampling is an equi-join.
    """
    rows = returns.filter(F.col(value).isNotNull()).select(*by, *order, value)
    rows = causal(rows, by, order, {"_i": prior_count()}, bounded=len(order) == 1 and one_row_per_day(rows, order[0]))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    draws = sizes.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))))
    draws = draws.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    draws = draws.withColumn("_i", F.floor(uniform(*by, "path", "step", seed) * F.col("_n")))
    totals = matched(draws, rows, [*by, "_i"]).groupBy(*by, "path").agg(F.sum(value).alias("total"))
    cut = group_quantiles(totals, by, "total", {"_cut": round(1 - confidence, 12)})
    return cut.select(*by, (-F.col("_cut")).alias("var"))


def var_backtest(returns: DataFrame, limits: DataFrame, by: list[str], value: str, confidence: float = 0.99) -> DataFrame:
    """Days on which the loss exceeded the limit, and whether that many are plausible."""
    joined = matched(returns.filter(F.col(value).isNotNull()), limits.select(*by, "var"), by)
    counts = joined.groupBy(*by).agg(F.count_if(F.col(value) < -F.col("var")).alias("exceptions"), F.count(F.lit(1)).alias("n_observations"))
    return counts.withColumns(kupiec("exceptions", "n_observations", confidence))
