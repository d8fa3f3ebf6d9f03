"""The business tables, derived from the given tables by one SQL text both engines read.

``{name}`` stands for a given table, ``@U(key,seed)@`` for a deterministic uniform number,
``@JSON(column,field)@`` for a text field of a JSON object and ``@N@`` for the rounding nudge.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {
    # Payments: one row per event; the device is the number in the JSON column.
    "transactions": """
        SELECT event_id AS Transaction_ID, ts AS Timestamp, user_id AS Customer_ID,
               @JSON(props,k)@ AS Device_ID, value AS Amount, event_type AS Transaction_Type,
               CAST(10 + event_id % 90 AS DOUBLE) AS Historical_Avg_Transaction,
               CAST(event_id % 60 AS INT) AS Account_Age_Months,
               CAST(1 + event_id % 27 AS DOUBLE) AS Transaction_Frequency,
               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS Fraud_Flag
        FROM {events}
    """,
    # A label with a score that carries signal and has ties.
    "scored": """
        SELECT event_id AS row_id, ts, user_id, event_type, value,
               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
               round(0.7E0 * @U(event_id,11)@ + CASE WHEN event_type = 'error' THEN 0.3E0 ELSE 0E0 END * @U(event_id,12)@, 3) AS score
        FROM {events}
    """,
    "loans": """
        SELECT o_orderkey AS Customer_ID,
               CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Corporate' ELSE 'Retail' END AS Customer_Type,
               c_mktsegment AS Segment,
               (c_acctbal + 1000E0) * 12E0 AS Annual_Income,
               o_totalprice AS Loan_Amount,
               greatest(c_acctbal, 0E0) * 40E0 AS Collateral_Value,
               CAST((o_orderkey % 7) * 10000 AS DOUBLE) AS Existing_Loan,
               CASE WHEN o_orderkey % 29 = 0 THEN 0E0 ELSE 6E0 + CAST(o_orderkey % 13 AS DOUBLE) * 0.75E0 END AS Interest_Rate,
               CAST(12 * (1 + o_orderkey % 30) AS INT) AS Loan_Term_Months,
               CAST(450 + (o_orderkey * 37) % 450 AS INT) AS Credit_Score,
               CAST(o_custkey % 31 AS INT) AS Employment_Length,
               CAST(o_orderkey % 97 AS DOUBLE) / 100E0 AS Debt_to_Income,
               CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS Past_Default,
               round(@U(o_orderkey,21)@, 6) AS Sector_Risk,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS Default_Flag,
               round(0.5E0 * @U(o_orderkey,22)@ * @U(o_orderkey,23)@ + CASE WHEN o_orderstatus = 'F' THEN 0.1E0 ELSE 0E0 END, 5) AS pd,
               o_orderdate
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
    """,
    "customers": """
        SELECT c_custkey AS Customer_ID, CAST(18 + c_custkey % 60 AS INT) AS Age,
               (c_acctbal + 1000E0) * 12E0 AS Annual_Income, c_acctbal AS Account_Balance,
               round(coalesce(spend, 0E0) * 0.1E0 + @N@, 2) AS Investment_Balance,
               CAST((c_custkey % 11) * 2500 AS DOUBLE) AS Loan_Balance,
               CAST(c_custkey % 4 AS INT) AS Complaints,
               CAST(c_custkey % 20 AS DOUBLE) * 0.5E0 AS Relationship_Length_Years,
               CAST(c_custkey % 6 AS INT) AS Products_Held,
               CAST(coalesce(n_orders, 0) AS DOUBLE) AS Transactions_Per_Month,
               CAST((c_custkey * 13) % 101 AS DOUBLE) AS Digital_Usage,
               round(coalesce(spend, 0E0) * 0.01E0 + @N@, 2) AS Estimated_CLV,
               CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS Churn_Flag,
               c_mktsegment AS Segment, c_nationkey
        FROM {customer}
        LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice) + @N@, 2) AS spend, count(*) AS n_orders FROM {orders} GROUP BY o_custkey) s
          ON c_custkey = o_custkey
    """,
    # One row per brand and shipping day.
    "market": """
        SELECT CAST(l_shipdate AS DATE) AS Date, p_brand AS Ticker,
               concat('S', CAST(CAST(substr(p_brand, 7) AS INT) % 5 AS STRING)) AS Sector,
               round(max(l_extendedprice), 2) AS High, round(min(l_extendedprice), 2) AS Low,
               round(avg(l_extendedprice) + @N@, 2) AS Close,
               CAST(sum(l_quantity) AS BIGINT) AS Volume,
               round(avg(l_discount - l_tax) + @N@, 6) AS Return,
               round(avg(l_discount) + @N@, 6) AS Market_Return,
               round(10E0 + 300E0 * avg(l_tax) + @N@, 4) AS VIX,
               round(avg(l_quantity * l_tax) + @N@, 4) AS Momentum_20D,
               round(0.01E0 + avg(l_tax) + @N@, 6) AS Volatility_20D
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
        GROUP BY CAST(l_shipdate AS DATE), p_brand
    """,
    # One business line: daily totals.
    "liquidity": """
        SELECT CAST(l_shipdate AS DATE) AS Date,
               round(sum(l_extendedprice) + @N@, 2) AS Deposits,
               round(sum(l_extendedprice * l_discount) + @N@, 2) AS Loan_Disbursements,
               round(sum(l_extendedprice * l_tax) + @N@, 2) AS Loan_Repayments,
               round(sum(l_quantity) * 100E0, 2) AS Wholesale_Funding,
               round(sum(l_quantity) * 1000E0, 2) AS Cash,
               round(sum(l_extendedprice) * 0.2E0 + @N@, 2) AS Securities_Holdings,
               round(sum(l_quantity * l_discount) * 50E0 + @N@, 2) AS Expected_Inflows,
               round(sum(l_quantity * l_tax) * 60E0 + @N@, 2) AS Expected_Outflows,
               round(avg(l_tax) * 40E0 + @N@, 4) AS Market_Stress,
               round(5E0 + avg(l_discount) + @N@, 4) AS Interest_Rate
        FROM {lineitem} GROUP BY CAST(l_shipdate AS DATE)
    """,
    "options": """
        SELECT p_partkey AS Option_ID, p_brand AS Underlying,
               CASE WHEN p_partkey % 2 = 0 THEN 'Call' ELSE 'Put' END AS Option_Type,
               date_add(DATE '2026-01-01', CAST((p_size * 14) AS INT)) AS Expiry,
               p_retailprice AS Spot,
               round(p_retailprice * (0.7E0 + 0.6E0 * @U(p_partkey,31)@), 2) AS Strike,
               CAST(p_size AS DOUBLE) / 25E0 AS Time_to_Maturity,
               0.1E0 + CAST(p_partkey % 40 AS DOUBLE) / 100E0 AS Volatility,
               0.01E0 * CAST(1 + p_partkey % 9 AS DOUBLE) AS Interest_Rate,
               round(p_retailprice * (0.05E0 + 0.2E0 * @U(p_partkey,32)@), 2) AS Market_Price,
               round(p_retailprice * (0.05E0 + 0.2E0 * @U(p_partkey,33)@), 2) AS Black_Scholes_Price,
               CAST(1 + p_partkey % 20 AS DOUBLE) AS position
        FROM {part}
    """,
    # Order-book tape: one row per event, grouped by event type and day.
    "tape": """
        SELECT event_id AS seq, ts AS Timestamp, event_type AS Stock, CAST(ts AS DATE) AS Trading_Day,
               CASE WHEN event_id % 3 = 0 THEN 'MARKET_ORDER' WHEN event_id % 3 = 1 THEN 'CANCEL' ELSE 'LIMIT_ORDER' END AS Event_Type,
               CASE WHEN user_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS Trade_Side,
               1000E0 - value * 0.01E0 AS Bid_Price_1, 999E0 - value * 0.02E0 AS Bid_Price_3,
               1001E0 + value * 0.01E0 AS Ask_Price_1, 1002E0 + value * 0.02E0 AS Ask_Price_3,
               1 + event_id % 50 AS Bid_Size_1, 1 + event_id % 31 AS Bid_Size_2, event_id % 17 AS Bid_Size_3,
               1 + event_id % 47 AS Ask_Size_1, 1 + event_id % 37 AS Ask_Size_2, event_id % 19 AS Ask_Size_3,
               3 + event_id % 50 + event_id % 31 + event_id % 17 + event_id % 47 + event_id % 37 + event_id % 19 AS Total_Depth,
               1000E0 + value AS Mid_Price, value * 0.001E0 - 0.02E0 AS Microprice_Minus_Mid,
               1E0 + value * 0.02E0 AS Spread, 0.001E0 + value * 0.00002E0 AS Relative_Spread,
               CAST(event_id % 41 AS DOUBLE) / 41E0 - 0.5E0 AS OBI_Level1,
               CAST(event_id % 43 AS DOUBLE) / 43E0 - 0.5E0 AS OBI_3Level,
               CAST(event_id % 23 AS DOUBLE) AS Order_Arrival_Rate, CAST(event_id % 13 AS DOUBLE) AS Cancellation_Rate,
               value AS Trade_Volume,
               CASE WHEN value < 15 THEN 'DOWN' WHEN value < 60 THEN 'FLAT' ELSE 'UP' END AS Price_Move_Class
        FROM {events}
    """,
    "initiatives": """
        SELECT p_partkey AS Initiative_ID, p_type AS Business_Unit,
               CASE WHEN p_size < 17 THEN 'Low' WHEN p_size < 34 THEN 'Medium' ELSE 'High' END AS Risk_Rating,
               p_retailprice AS Initial_Investment,
               p_retailprice * (0.3E0 + 0.4E0 * @U(p_partkey,41)@) AS Revenue_Year1,
               p_retailprice * (0.3E0 + 0.5E0 * @U(p_partkey,42)@) AS Revenue_Year2,
               p_retailprice * (0.3E0 + 0.6E0 * @U(p_partkey,43)@) AS Revenue_Year3,
               CAST(p_size AS DOUBLE) * 2E0 AS Operating_Cost,
               CAST(p_partkey % 20 AS DOUBLE) AS Business_Growth, CAST(p_partkey % 7 AS DOUBLE) AS GDP_Growth,
               CAST(5 + p_partkey % 30 AS DOUBLE) AS Expected_ROI, CAST(4 + p_partkey % 6 AS DOUBLE) AS Interest_Rate,
               CAST(p_partkey % 100 AS DOUBLE) AS Competition_Index,
               CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS Historical_Success,
               round(@U(p_partkey,44)@, 4) AS success_probability
        FROM {part}
    """,
    # Four trading books with one return per day.
    "book_returns": """
        SELECT concat(l_returnflag, l_linestatus) AS book, CAST(l_shipdate AS DATE) AS Date,
               round(avg(l_discount - l_tax) * 0.1E0 + @N@, 6) AS ret
        FROM {lineitem} GROUP BY concat(l_returnflag, l_linestatus), CAST(l_shipdate AS DATE)
    """,
}

_NEEDS = {name: re.findall(r"\{(\w+)\}", text) for name, text in VIEWS.items()}


#: Added before rounding in both engines: sums taken in another order differ in the last bit, which
#: must not decide which way an exact half is rounded.  Its digits keep decimal inputs off a half.
NUDGE = 1.2345678901e-9


def _spark_text(text: str) -> str:
    text = re.sub(
        r"@U\((\w+),(\d+)\)@",
        r"(CAST(conv(substr(md5(concat_ws(':', CAST(\1 AS STRING), '\2')), 1, 13), 16, 10) AS BIGINT) / 4503599627370496E0)", text,
    )
    text = text.replace("@N@", f"{NUDGE!r}D")
    return re.sub(r"@JSON\((\w+),(\w+)\)@", r"get_json_object(\1, '$.\2')", text)


def _oracle_text(text: str) -> str:
    text = re.sub(
        r"@U\(([\w.]+),(\w+)\)@",
        r"(CAST(('0x' || substr(md5(concat_ws(':', CAST(\1 AS VARCHAR), '\2')), 1, 13)) AS BIGINT) / 4503599627370496)", text,
    )
    text = re.sub(r"@JSON\((\w+),(\w+)\)@", r"json_extract_string(\1, '$.\2')", text)
    text = text.replace("@N@", f"{NUDGE!r}")
    text = re.sub(r"\bAS STRING\b", "AS VARCHAR", text)
    text = re.sub(r"date_add\((DATE '[\d-]+'), (CAST\(\([^)]*\) AS INT\))\)", r"(\1 + \2)", text)
    return re.sub(r"\{(\w+)\}", r"\1", text)


def with_views(sql: str) -> str:
    """Put the definitions of the views a query names in front of it."""
    sql = _oracle_text(sql)
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    ctes = ",\n".join(f"{v} AS ({_oracle_text(VIEWS[v])})" for v in used)
    return f"WITH {ctes}\n{sql}"


class Tables:
    """Given tables and business views as attributes, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(self.path(name))
        if name in VIEWS:
            return self.spark.sql(_spark_text(VIEWS[name]), **{t: getattr(self, t) for t in set(_NEEDS[name])})
        raise AttributeError(name)

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"
