"""Causal history, ranks and feature tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.bands import bin_right_closed
from ..functions.scalar import flag, safe_div, seconds_between
from ..operators import features as fx
from ..operators.ordered import (
    average_rank, causal, expanding, lag, lead, prior_count, quantiles, rolling, row_position, running,
)
from .registry import query
from .views import NUDGE

W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def _past(n):
    return f"OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@query(
    "surprise_decile_rate",
    f"""
    WITH h AS (SELECT event_type, value, avg(value) {_past(5)} AS m, stddev_samp(value) {_past(5)} AS s FROM events),
    z AS (SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
                 round((value - m) / nullif(s, 0) + @N@, 6) AS z FROM h),
    zz AS (SELECT * FROM z WHERE z IS NOT NULL),
    e AS (SELECT quantile_cont(z, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS edges FROM zz)
    SELECT CAST(len(list_filter(edges, lambda x: x < z)) + 1 AS INT) AS bin, count(*) AS n,
           CAST(sum(label) AS BIGINT) AS n_events, avg(label) AS event_rate
    FROM zz, e GROUP BY 1
    """,
    {"event_rate": 6},
)
def _(t):
    n = t.events.count()  # from file footers
    past = causal(t.events.select("event_id", "ts", "user_id", "event_type", "value"), ["user_id"], ["ts", "event_id"], {
        "m": rolling("value", 5, "mean"), "s": rolling("value", 5, "std"),
    }, total=n)
    z = past.select(
        flag(F.col("event_type") == "error").alias("label"),
        F.round(safe_div(F.col("value") - F.col("m"), "s") + NUDGE, 6).alias("z"),
    ).filter("z IS NOT NULL")
    edges = quantiles(z, "z", [i / 10 for i in range(1, 10)], n)
    bins = F.size(F.filter(F.lit(edges), lambda e: e < F.col("z"))) + 1
    return z.groupBy(bins.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_events"), F.avg("label").alias("event_rate"))


@query("causal_shift", f"SELECT event_id, lag(value, 1) {W} AS prev_1, lag(value, 3) {W} AS prev_3 FROM events", {"prev_1": 6, "prev_3": 6})
def _(t):
    out = causal(t.events, ["user_id"], ["ts", "event_id"], {"prev_1": lag("value"), "prev_3": lag("value", 3)})
    return out.select("event_id", "prev_1", "prev_3")


@query(
    "causal_rolling",
    f"""SELECT event_id, avg(value) {_past(5)} AS mean_5, stddev_samp(value) {_past(5)} AS std_5, sum(value) {_past(7)} AS sum_7,
    min(value) {_past(10)} AS min_10, max(value) {_past(10)} AS max_10, quantile_cont(value, 0.5) {_past(20)} AS median_20,
    count(value) {_past(20)} AS n_20, CASE WHEN count(value) {_past(8)} >= 8 THEN avg(value) {_past(8)} END AS full_mean_8
    FROM events""",
    {"mean_5": 6, "std_5": 6, "sum_7": 6, "min_10": 6, "max_10": 6, "median_20": 6, "full_mean_8": 6},
)
def _(t):
    out = {
        "mean_5": rolling("value", 5, "mean"), "std_5": rolling("value", 5, "std"), "sum_7": rolling("value", 7, "sum"),
        "min_10": rolling("value", 10, "min"), "max_10": rolling("value", 10, "max"),
        "median_20": rolling("value", 20, "median"), "n_20": rolling("value", 20, "count"),
        "full_mean_8": rolling("value", 8, "mean", min_periods=8),
    }
    return causal(t.events, ["user_id"], ["ts", "event_id"], out).select("event_id", *out)


@query(
    "causal_expanding",
    f"""SELECT event_id, avg(value) {_past('UNBOUNDED')} AS mean_all, stddev_samp(value) {_past('UNBOUNDED')} AS std_all,
    min(value) {_past('UNBOUNDED')} AS min_all, max(value) {_past('UNBOUNDED')} AS max_all,
    count(value) {_past('UNBOUNDED')} AS n_all, row_number() {W} - 1 AS position FROM events""",
    {"mean_all": 6, "std_all": 6, "min_all": 6, "max_all": 6},
)
def _(t):
    out = {
        **{f"{s}_all": expanding("value", s) for s in ("mean", "std", "min", "max")},
        "n_all": expanding("value", "count"), "position": prior_count(),
    }
    return causal(t.events, ["user_id"], ["ts", "event_id"], out).select("event_id", *out)


@query(
    "cross_sectional_rank",
    """SELECT event_id, (rank() OVER (PARTITION BY d ORDER BY value) + (count(*) OVER (PARTITION BY d, value) - 1) / 2.0)
       / count(value) OVER (PARTITION BY d) AS day_rank FROM (SELECT event_id, value, CAST(ts AS DATE) AS d FROM events)""",
    {"day_rank": 9},
)
def _(t):
    df = t.events.select("event_id", "value", F.to_date("ts").alias("d"))
    return average_rank(df, ["d"], "value", "day_rank").select("event_id", "day_rank")


@query("forward_target", f"SELECT event_id, lead(value, 1) {W} AS next_1, lead(value, 5) {W} AS next_5 FROM events", {"next_1": 6, "next_5": 6})
def _(t):
    out = causal(t.events, ["user_id"], ["ts", "event_id"], {"next_1": lead("value"), "next_5": lead("value", 5)})
    return out.select("event_id", "next_1", "next_5")


@query(
    "drop_missing_target",
    f"SELECT user_id, count(*) AS n_kept FROM (SELECT user_id, lead(value, 2) {W} AS y FROM events) WHERE y IS NOT NULL GROUP BY user_id",
)
def _(t):
    out = causal(t.events.select("event_id", "ts", "user_id", "value"), ["user_id"], ["ts", "event_id"], {"y": lead("value", 2)})
    return out.filter("y IS NOT NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_kept"))


@query(
    "running_counts",
    f"""SELECT event_id, row_number() {W} - 1 AS user_n,
        row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS type_day_n FROM events""",
)
def _(t):
    df = t.events.select("event_id", "ts", "user_id", "event_type", F.to_date("ts").alias("day"))
    df = causal(df, ["user_id"], ["ts", "event_id"], {"user_n": prior_count()})
    df = causal(df, ["event_type", "day"], ["ts", "event_id"], {"type_day_n": prior_count()})
    return df.select("event_id", "user_n", "type_day_n")


@query(
    "inter_event_time",
    f"""SELECT event_id, s AS seconds_since_prev, s / 3600 AS hours_since_prev, CASE WHEN s < 3600 THEN 1 ELSE 0 END AS rapid_repeat
        FROM (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) {W})) / 1e6 AS s FROM events)""",
    {"seconds_since_prev": 6, "hours_since_prev": 6},
)
def _(t):
    df = causal(t.events.select("event_id", "ts", "user_id"), ["user_id"], ["ts", "event_id"], {"prev": lag("ts")})
    s = seconds_between("ts", "prev")
    return df.select("event_id", s.alias("seconds_since_prev"), (s / 3600).alias("hours_since_prev"), flag(s < 3600).alias("rapid_repeat"))


@query(
    "entity_change_flag",
    """SELECT Transaction_ID, CASE WHEN p IS NOT NULL AND p <> Customer_ID THEN 1 ELSE 0 END AS changed
       FROM (SELECT Transaction_ID, Customer_ID, lag(Customer_ID) OVER (PARTITION BY Device_ID ORDER BY Timestamp, Transaction_ID) AS p FROM transactions)""",
)
def _(t):
    df = causal(t.transactions.select("Transaction_ID", "Timestamp", "Device_ID", "Customer_ID"), ["Device_ID"],
                ["Timestamp", "Transaction_ID"], {"p": lag("Customer_ID")})
    return df.select("Transaction_ID", flag(F.col("p").isNotNull() & (F.col("p") != F.col("Customer_ID"))).alias("changed"))


TX_OUT = {
    "amount_vs_history": 6, "amount_log": 6, "amount_excess": 6, "account_age_years": 6, "hour_sin": 6, "hour_cos": 6,
    "cust_prev_amount": 6, "cust_mean_amount_5": 6, "cust_std_amount_5": 6, "cust_max_amount_10": 6, "cust_mean_amount_all": 6,
    "amount_vs_cust_mean": 6, "amount_z_vs_cust": 5, "amount_vs_cust_max": 6, "seconds_since_prev": 6, "hours_since_prev": 6,
    "device_mean_amount": 6, "amount_vs_device_mean": 6, "txn_frequency_norm": 6,
}
TX_INT = ["new_account", "hour", "day_of_week", "is_weekend", "is_night", "cust_txn_count", "rapid_repeat", "device_txn_count", "device_customer_changed"]


@query(
    "transaction_features",
    """
    WITH w AS (SELECT *,
        lag(Amount) OVER c AS cust_prev_amount, avg(Amount) OVER c5 AS cust_mean_amount_5, stddev_samp(Amount) OVER c5 AS cust_std_amount_5,
        max(Amount) OVER c10 AS cust_max_amount_10, avg(Amount) OVER ca AS cust_mean_amount_all, row_number() OVER c - 1 AS cust_txn_count,
        (epoch_us(Timestamp) - epoch_us(lag(Timestamp) OVER c)) / 1e6 AS seconds_since_prev,
        row_number() OVER d - 1 AS device_txn_count, avg(Amount) OVER da AS device_mean_amount, lag(Customer_ID) OVER d AS prev_customer
      FROM transactions
      WINDOW c AS (PARTITION BY Customer_ID ORDER BY Timestamp, Transaction_ID),
        c5 AS (PARTITION BY Customer_ID ORDER BY Timestamp, Transaction_ID ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
        c10 AS (PARTITION BY Customer_ID ORDER BY Timestamp, Transaction_ID ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
        ca AS (PARTITION BY Customer_ID ORDER BY Timestamp, Transaction_ID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        d AS (PARTITION BY Device_ID ORDER BY Timestamp, Transaction_ID),
        da AS (PARTITION BY Device_ID ORDER BY Timestamp, Transaction_ID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT Transaction_ID, Amount / nullif(Historical_Avg_Transaction, 0) AS amount_vs_history, ln(1 + Amount) AS amount_log,
      Amount - Historical_Avg_Transaction AS amount_excess, Account_Age_Months / 12.0 AS account_age_years,
      CASE WHEN Account_Age_Months < 12 THEN 1 ELSE 0 END AS new_account,
      CAST(hour(Timestamp) AS INT) AS hour, CAST(isodow(Timestamp) - 1 AS INT) AS day_of_week,
      CASE WHEN isodow(Timestamp) >= 6 THEN 1 ELSE 0 END AS is_weekend,
      CASE WHEN hour(Timestamp) < 6 OR hour(Timestamp) >= 22 THEN 1 ELSE 0 END AS is_night,
      sin(2 * pi() * hour(Timestamp) / 24) AS hour_sin, cos(2 * pi() * hour(Timestamp) / 24) AS hour_cos,
      cust_prev_amount, cust_mean_amount_5, cust_std_amount_5, cust_max_amount_10, cust_mean_amount_all, cust_txn_count,
      Amount / nullif(cust_mean_amount_5, 0) AS amount_vs_cust_mean, (Amount - cust_mean_amount_5) / nullif(cust_std_amount_5, 0) AS amount_z_vs_cust,
      Amount / nullif(cust_max_amount_10, 0) AS amount_vs_cust_max, seconds_since_prev, seconds_since_prev / 3600 AS hours_since_prev,
      CASE WHEN seconds_since_prev < 3600 THEN 1 ELSE 0 END AS rapid_repeat,
      device_txn_count, device_mean_amount, Amount / nullif(device_mean_amount, 0) AS amount_vs_device_mean,
      CASE WHEN prev_customer <> Customer_ID THEN 1 ELSE 0 END AS device_customer_changed, Transaction_Frequency / 27.0 AS txn_frequency_norm
    FROM w
    """,
    TX_OUT,
)
def _(t):
    return fx.transaction_features(t.transactions).select("Transaction_ID", *TX_OUT, *TX_INT)


PANEL_OUT = {
    n: 6 for n in (
        "fwd_return_1d", "fwd_return_5d", "ret_lag_1", "ret_lag_2", "ret_lag_3", "ret_lag_5", "ret_lag_10", "ret_mean_5", "ret_mean_20",
        "ret_std_5", "ret_std_20", "ret_median_20", "volume_log", "volume_mean_20", "volume_surprise", "excess_return_lag1",
        "vix_lag1", "vix_change", "rank_momentum", "rank_volatility", "rank_reversal", "momentum_vs_sector", "risk_adj_momentum",
    )
} | {"momentum_ratio": 4, "vol_ratio": 4}


@query(
    "panel_features",
    """
    WITH b AS (SELECT *, ln(1 + Volume) AS volume_log FROM market),
    w AS (SELECT *,
        lead(Return, 1) OVER e AS fwd_return_1d, lead(Return, 5) OVER e AS fwd_return_5d, lag(Return, 1) OVER e AS ret_lag_1,
        lag(Return, 2) OVER e AS ret_lag_2, lag(Return, 3) OVER e AS ret_lag_3, lag(Return, 5) OVER e AS ret_lag_5, lag(Return, 10) OVER e AS ret_lag_10,
        avg(Return) OVER e5 AS ret_mean_5, avg(Return) OVER e20 AS ret_mean_20, stddev_samp(Return) OVER e5 AS ret_std_5,
        stddev_samp(Return) OVER e20 AS ret_std_20, quantile_cont(Return, 0.5) OVER e20 AS ret_median_20,
        avg(volume_log) OVER e20 AS volume_mean_20, lag(Market_Return) OVER e AS market_lag, lag(VIX) OVER e AS vix_lag1, avg(VIX) OVER e20 AS vix_mean
      FROM b
      WINDOW e AS (PARTITION BY Ticker ORDER BY Date), e5 AS (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
        e20 AS (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    r AS (SELECT *, -ret_lag_1 AS reversal, volume_log - volume_mean_20 AS volume_surprise,
        (rank() OVER (PARTITION BY Date ORDER BY Momentum_20D) + (count(*) OVER (PARTITION BY Date, Momentum_20D) - 1) / 2.0) / count(Momentum_20D) OVER (PARTITION BY Date) AS rank_momentum,
        (rank() OVER (PARTITION BY Date ORDER BY Volatility_20D) + (count(*) OVER (PARTITION BY Date, Volatility_20D) - 1) / 2.0) / count(Volatility_20D) OVER (PARTITION BY Date) AS rank_volatility,
        Momentum_20D - avg(Momentum_20D) OVER (PARTITION BY Date, Sector) AS momentum_vs_sector FROM w),
    q AS (SELECT *, CASE WHEN reversal IS NOT NULL THEN (rank() OVER (PARTITION BY Date ORDER BY reversal NULLS LAST) + (count(*) OVER (PARTITION BY Date, reversal) - 1) / 2.0)
        / count(reversal) OVER (PARTITION BY Date) END AS rank_reversal FROM r)
    SELECT Date, Ticker, fwd_return_1d, fwd_return_5d, ret_lag_1, ret_lag_2, ret_lag_3, ret_lag_5, ret_lag_10, ret_mean_5, ret_mean_20, ret_std_5, ret_std_20,
      ret_median_20, ret_mean_5 / (ret_std_20 + 1e-9) AS momentum_ratio, ret_std_5 / (ret_std_20 + 1e-9) AS vol_ratio,
      Momentum_20D / (Volatility_20D + 1e-9) AS risk_adj_momentum, volume_log, volume_mean_20, volume_surprise,
      ret_lag_1 - market_lag AS excess_return_lag1, vix_lag1, vix_lag1 - vix_mean AS vix_change,
      CASE WHEN vix_lag1 > 20 THEN 1 ELSE 0 END AS high_vol_regime, rank_momentum, rank_volatility, rank_reversal, momentum_vs_sector
    FROM q WHERE fwd_return_1d IS NOT NULL
    """,
    PANEL_OUT,
)
def _(t):
    # The rank of a difference of logarithms may tie or not by the last bit, so it is checked in the tests instead.
    return fx.panel_features(t.market).select("Date", "Ticker", "high_vol_regime", *PANEL_OUT)


@query(
    "group_relative_value",
    "SELECT Date, Ticker, Momentum_20D - avg(Momentum_20D) OVER (PARTITION BY Date, Sector) AS relative FROM market",
    {"relative": 6},
)
def _(t):
    return fx.group_relative(t.market, ["Date", "Sector"], "Momentum_20D", "relative").select("Date", "Ticker", "relative")


SERIES_BASE = ["Deposits", "Loan_Disbursements", "Loan_Repayments", "Wholesale_Funding", "Expected_Inflows", "Expected_Outflows", "Market_Stress", "Interest_Rate"]
SERIES_OUT = {"fwd_outflows_5d": 2, "fwd_inflows_5d": 2}
_series_sql = []
for _b in SERIES_BASE:
    for _k in (1, 2, 5):
        SERIES_OUT[f"{_b.lower()}_lag_{_k}"] = 4
        _series_sql.append(f"lag({_b}, {_k}) OVER e AS {_b.lower()}_lag_{_k}")
    for _stat, _fn, _n in (("ma_5", "avg", 5), ("ma_20", "avg", 20), ("std_20", "stddev_samp", 20)):
        SERIES_OUT[f"{_b.lower()}_{_stat}"] = 3
        _series_sql.append(f"{_fn}({_b}) OVER e{_n} AS {_b.lower()}_{_stat}")
SERIES_OUT |= {n: 4 for n in ("net_loan_flow_lag1", "funding_ratio_lag1", "coverage_lag1", "liquid_assets_lag1", "lcr_proxy_lag1")}


@query(
    "series_features",
    f"""
    WITH w AS (SELECT *, lead(Expected_Outflows, 5) OVER e AS fwd_outflows_5d, lead(Expected_Inflows, 5) OVER e AS fwd_inflows_5d,
      {", ".join(_series_sql)}, lag(Cash) OVER e + lag(Securities_Holdings) OVER e AS liquid_assets_lag1
      FROM liquidity WINDOW e AS (ORDER BY Date), e5 AS (ORDER BY Date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
        e20 AS (ORDER BY Date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT Date, {", ".join(n for n in SERIES_OUT if n not in ("net_loan_flow_lag1", "funding_ratio_lag1", "coverage_lag1", "lcr_proxy_lag1"))},
      loan_disbursements_lag_1 - loan_repayments_lag_1 AS net_loan_flow_lag1, wholesale_funding_lag_1 / nullif(deposits_lag_1, 0) AS funding_ratio_lag1,
      expected_inflows_lag_1 / nullif(expected_outflows_lag_1, 0) AS coverage_lag1, liquid_assets_lag1 / nullif(expected_outflows_lag_1, 0) AS lcr_proxy_lag1,
      CASE WHEN market_stress_lag_1 > 1.5 THEN 1 ELSE 0 END AS stress_flag_lag1, CAST(isodow(Date) - 1 AS INT) AS day_of_week,
      CAST(month(Date) AS INT) AS month, CASE WHEN Date = last_day(Date) THEN 1 ELSE 0 END AS is_month_end,
      CASE WHEN Date = last_day(Date) AND month(Date) % 3 = 0 THEN 1 ELSE 0 END AS is_quarter_end
    FROM w WHERE fwd_outflows_5d IS NOT NULL
    """,
    SERIES_OUT,
)
def _(t):
    return fx.series_features(t.liquidity).select(
        "Date", *SERIES_OUT, "stress_flag_lag1", "day_of_week", "month", "is_month_end", "is_quarter_end")


TAPE_OUT = {n: 6 for n in (
    "obi_lag_1", "obi_mean_10", "obi_mean_50", "obi_change", "obi_vs_mean", "mid_lag_1", "mid_return_bps", "mid_mean_20",
    "mid_vs_mean_bps", "spread_mean_20", "spread_vs_mean", "volume_mean_20", "volume_surprise", "buy_pressure_20", "cancel_rate_20")}


@query(
    "tape_features",
    """
    WITH b AS (SELECT *, ln(1 + Trade_Volume) AS tv, CASE WHEN Trade_Side = 'BUY' THEN 1 ELSE 0 END AS buy, CASE WHEN Event_Type = 'CANCEL' THEN 1 ELSE 0 END AS cancel FROM tape),
    w AS (SELECT *, lag(OBI_Level1) OVER e AS obi_lag_1, avg(OBI_Level1) OVER e10 AS obi_mean_10, avg(OBI_3Level) OVER e50 AS obi_mean_50, lag(Mid_Price) OVER e AS mid_lag_1,
        avg(Mid_Price) OVER e20 AS mid_mean_20, avg(Relative_Spread) OVER e20 AS spread_mean_20, avg(tv) OVER e20 AS volume_mean_20, avg(buy) OVER e20 AS buy_pressure_20,
        avg(cancel) OVER e20 AS cancel_rate_20, row_number() OVER e - 1 AS tick_index FROM b
      WINDOW e AS (PARTITION BY Stock, Trading_Day ORDER BY Timestamp, seq),
        e10 AS (PARTITION BY Stock, Trading_Day ORDER BY Timestamp, seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
        e20 AS (PARTITION BY Stock, Trading_Day ORDER BY Timestamp, seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
        e50 AS (PARTITION BY Stock, Trading_Day ORDER BY Timestamp, seq ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
    SELECT seq, obi_lag_1, obi_mean_10, obi_mean_50, OBI_Level1 - obi_lag_1 AS obi_change, OBI_Level1 - obi_mean_10 AS obi_vs_mean, mid_lag_1,
      (Mid_Price - mid_lag_1) / nullif(mid_lag_1, 0) * 10000 AS mid_return_bps, mid_mean_20, (Mid_Price - mid_mean_20) / nullif(mid_mean_20, 0) * 10000 AS mid_vs_mean_bps,
      spread_mean_20, Relative_Spread - spread_mean_20 AS spread_vs_mean, volume_mean_20, tv - volume_mean_20 AS volume_surprise, buy_pressure_20, cancel_rate_20, tick_index
    FROM w
    """,
    TAPE_OUT,
)
def _(t):
    return fx.tape_features(t.tape).select("seq", "tick_index", *TAPE_OUT)


@query(
    "customer_priority",
    """
    WITH b AS (SELECT Customer_ID, Estimated_CLV AS v, Complaints / nullif(Relationship_Length_Years, 0) AS cy,
        round(Digital_Usage / 100 * 0.4 + (Transactions_Per_Month / 35) * 0.3 + (Products_Held / 6) * 0.3 + @N@, 9) AS en FROM customers),
    r AS (SELECT Customer_ID, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / count(v) OVER () AS vr,
        CASE WHEN cy IS NOT NULL THEN (rank() OVER (ORDER BY cy NULLS LAST) + (count(*) OVER (PARTITION BY cy) - 1) / 2.0) / count(cy) OVER () END AS cr,
        (rank() OVER (ORDER BY en) + (count(*) OVER (PARTITION BY en) - 1) / 2.0) / count(en) OVER () AS er FROM b)
    SELECT Customer_ID, vr AS decision_value_rank, cr * 0.6 + (1 - er) * 0.4 AS decision_attrition_proxy, vr * (cr * 0.6 + (1 - er) * 0.4) AS decision_priority_score FROM r
    """,
    {"decision_value_rank": 6, "decision_attrition_proxy": 6, "decision_priority_score": 6},
)
def _(t):
    df = fx.customer_features(t.customers).withColumn("engagement_score", F.round(F.col("engagement_score") + NUDGE, 9))
    return fx.customer_priority(df).select("Customer_ID", "decision_value_rank", "decision_attrition_proxy", "decision_priority_score")


@query(
    "pct_change",
    "SELECT Date, Ticker, Close / nullif(lag(Close) OVER (PARTITION BY Ticker ORDER BY Date), 0) - 1 AS change FROM market",
    {"change": 6},
)
def _(t):
    return fx.pct_change(t.market, ["Ticker"], ["Date"], "Close", "change").select("Date", "Ticker", "change")


@query(
    "equity_and_drawdown",
    """
    WITH e AS (SELECT book, Date, exp(sum(ln(1 + ret)) OVER (PARTITION BY book ORDER BY Date)) AS equity FROM book_returns)
    SELECT book, Date, equity, equity / max(equity) OVER (PARTITION BY book ORDER BY Date) - 1 AS drawdown FROM e
    """,
    {"equity": 6, "drawdown": 6},
)
def _(t):
    df = t.book_returns.withColumn("growth", fx.simple_equity("ret"))
    df = causal(df, ["book"], ["Date"], {"total": running("growth", "sum")}).withColumn("equity", F.exp("total"))
    df = causal(df, ["book"], ["Date"], {"peak": running("equity", "max")})
    return df.select("book", "Date", "equity", (F.col("equity") / F.col("peak") - 1).alias("drawdown"))


CAUSAL_FEATURES = [*TX_OUT, *TX_INT]


def _causal_sql(count: str, features: list[str]) -> str:
    return f"""
    WITH n AS ({count})
    SELECT n AS n_compared, feature, CAST(0 AS BIGINT) AS n_changed, true AS is_causal
    FROM n, (SELECT unnest([{", ".join(f"'{f}'" for f in features)}]) AS feature)
    """


@query("causality_proof", _causal_sql("SELECT count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-25 00:00:00'", CAUSAL_FEATURES))
def _(t):
    return fx.causality_proof(
        t.transactions, fx.transaction_features, "Transaction_ID", "Timestamp", dt.datetime(2024, 1, 25),
        ["Amount", "Historical_Avg_Transaction", "Customer_ID", "Device_ID", "Account_Age_Months", "Timestamp"], CAUSAL_FEATURES)


PANEL_PAST = [*(f for f in PANEL_OUT if not f.startswith("fwd_")), "high_vol_regime", "rank_volume_surprise"]


@query("causality_proof_panel", _causal_sql(
    """SELECT count(*) AS n FROM (SELECT Date, lead(Return) OVER (PARTITION BY Ticker ORDER BY Date) AS f FROM market)
       WHERE f IS NOT NULL AND Date < DATE '1996-06-01'""", PANEL_PAST))
def _(t):
    return fx.causality_proof(
        t.market, fx.panel_features, ["Ticker", "Date"], "Date", dt.date(1996, 6, 1),
        ["Return", "Market_Return", "VIX", "Volume", "Momentum_20D", "Volatility_20D", "Sector"], PANEL_PAST)


SERIES_PAST = [*(f for f in SERIES_OUT if not f.startswith("fwd_")), "stress_flag_lag1"]


@query("causality_proof_series", _causal_sql(
    """SELECT count(*) AS n FROM (SELECT Date, lead(Expected_Outflows, 5) OVER (ORDER BY Date) AS f FROM liquidity)
       WHERE f IS NOT NULL AND Date < DATE '1996-06-01'""", SERIES_PAST))
def _(t):
    return fx.causality_proof(t.liquidity, fx.series_features, "Date", "Date", dt.date(1996, 6, 1), [*SERIES_BASE, "Cash", "Securities_Holdings"], SERIES_PAST)


TAPE_PAST = [*TAPE_OUT, "tick_index"]


@query("causality_proof_tape", _causal_sql("SELECT count(*) AS n FROM tape WHERE Timestamp < TIMESTAMP '2024-01-15 11:00:00'", TAPE_PAST))
def _(t):
    return fx.causality_proof(
        t.tape, fx.tape_features, "seq", "Timestamp", dt.datetime(2024, 1, 15, 11),
        ["OBI_Level1", "OBI_3Level", "Mid_Price", "Relative_Spread", "Trade_Volume", "Trade_Side", "Event_Type", "Stock"], TAPE_PAST)


def _leaky(df):
    """Two features that look ahead beside one that does not."""
    df = causal(df, ["Customer_ID"], ["Timestamp", "Transaction_ID"], {"prev_amount": lag("Amount"), "next_amount": lead("Amount")})
    return fx.group_relative(df, ["Customer_ID"], "Amount", "amount_vs_customer")


@query(
    "causality_leak_found",
    """
    WITH w AS (SELECT *, lead(Timestamp) OVER c AS next_time, lead(Amount) OVER c AS next_amount, max(Timestamp) FILTER (Amount IS NOT NULL) OVER (PARTITION BY Customer_ID) AS last_time
               FROM transactions WINDOW c AS (PARTITION BY Customer_ID ORDER BY Timestamp, Transaction_ID)),
    e AS (SELECT *, TIMESTAMP '2024-01-25 00:00:00' AS cut FROM w WHERE Timestamp < TIMESTAMP '2024-01-25 00:00:00'),
    s AS (SELECT count(*) AS n_compared, count(*) FILTER (next_time >= cut AND next_amount IS NOT NULL) AS ahead,
                 count(*) FILTER (last_time >= cut AND Amount IS NOT NULL) AS whole FROM e)
    SELECT n_compared, 'prev_amount' AS feature, CAST(0 AS BIGINT) AS n_changed, true AS is_causal FROM s
    UNION ALL SELECT n_compared, 'next_amount', ahead, ahead = 0 FROM s
    UNION ALL SELECT n_compared, 'amount_vs_customer', whole, whole = 0 FROM s
    """,
)
def _(t):
    return fx.causality_proof(
        t.transactions, _leaky, "Transaction_ID", "Timestamp", dt.datetime(2024, 1, 25), ["Amount"], ["prev_amount", "next_amount", "amount_vs_customer"])


@query(
    "running_median",
    """
    SELECT event_id, quantile_cont(value, 0.5) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS median_before,
      quantile_cont(value, 0.5) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS median_upto
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)
    """,
    {"median_before": 6, "median_upto": 6},
)
def _(t):
    """Few groups, each with a large share of all rows: where they are cut, no task holds a whole one."""
    wanted = {"median_before": expanding("value", "median"), "median_upto": running("value", "median")}
    return causal(t.events, ["event_type"], ["ts", "event_id"], wanted).select("event_id", *wanted)


@query(
    "global_position",
    "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events",
)
def _(t):
    return row_position(t.events.select("event_id", "ts"), ["ts", "event_id"], "position").select("event_id", "position")


@query(
    "quantile_bins",
    """
    WITH e AS (SELECT quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0]) AS edges FROM events)
    SELECT CAST(greatest(len(list_filter(edges, lambda x: x < value)), 1) AS INT) AS bin, count(*) AS n FROM events, e GROUP BY 1
    """,
)
def _(t):
    edges = quantiles(t.events, "value", [0, 0.25, 0.5, 0.75, 1])
    return t.events.groupBy(bin_right_closed("value", edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
