"""Profiles, leak detectors, encodings and feature filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, encode
from ..session import materialise
from ..sources import specs
from .registry import query

LEAKY = """SELECT *, Loan_Amount + Existing_Loan AS Total_Exposure, Default_Flag * 2 + 1 AS Default_Alias, 11385 + Sector_Risk AS Steady FROM loans"""


def leaky(t):
    return t.loans.withColumns({
        "Total_Exposure": F.col("Loan_Amount") + F.col("Existing_Loan"), "Default_Alias": F.col("Default_Flag") * 2 + 1,
        "Steady": F.lit(11385) + F.col("Sector_Risk"),
    })


def _profile_sql(table, numeric, text, times):
    parts = []
    for n, kind in [*[(n, "n") for n in numeric], *[(n, "t") for n in text], *[(n, "d") for n in times]]:
        num = (lambda fn: f"{fn}(CAST({n} AS DOUBLE))") if kind == "n" else (lambda fn: "CAST(NULL AS DOUBLE)")  # noqa: B023
        tim = (lambda fn: f"CAST({fn}({n}) AS TIMESTAMP)") if kind == "d" else (lambda fn: "CAST(NULL AS TIMESTAMP)")  # noqa: B023
        top = "''"
        if kind != "d":
            top = f"""(SELECT string_agg(v || '=' || c, ', ' ORDER BY c DESC, v) FROM (SELECT CAST({n} AS VARCHAR) AS v, count(*) AS c FROM {table}
                 WHERE {n} IS NOT NULL GROUP BY 1 ORDER BY c DESC, v LIMIT 5))"""
            if kind == "n":
                top = f"CASE WHEN count(DISTINCT {n}) <= 12 THEN {top} ELSE '' END"
        parts.append(
            f"""SELECT '{n}' AS "column", count(*) - count({n}) AS missing, (count(*) - count({n})) / count(*) * 100 AS missing_pct, count(DISTINCT {n}) AS n_unique,
            count(DISTINCT {n}) / count(*) * 100 AS unique_pct, {num('min')} AS min, {num('max')} AS max, {num('avg')} AS mean, {num('stddev_samp')} AS std,
            {tim('min')} AS first, {tim('max')} AS last, {top} AS top_values FROM {table}""")
    return " UNION ALL ".join(parts)


@query(
    "column_profile",
    _profile_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                 ["l_returnflag", "l_linestatus"], ["l_shipdate"]),
    {"missing_pct": 4, "unique_pct": 4, "min": 4, "max": 4, "mean": 4, "std": 4},
)
def _(t):
    return audit.column_profile(t.lineitem).drop("dtype")


@query(
    "class_balance",
    """SELECT o_orderstatus, n AS count, n / sum(n) OVER () AS proportion, max(n) OVER () / min(n) OVER () AS imbalance_ratio
       FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)""",
    {"proportion": 6, "imbalance_ratio": 6},
)
def _(t):
    return audit.class_balance(t.orders, "o_orderstatus")


@query(
    "decile_lift",
    """
    WITH e AS (SELECT quantile_cont(Loan_Amount, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]) AS edges FROM loans),
    b AS (SELECT CAST(greatest(len(list_filter(edges, lambda x: x < Loan_Amount)), 1) AS INT) AS bin, Default_Flag AS y FROM loans, e)
    SELECT bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_events, avg(y) AS event_rate, avg(y) / (SELECT avg(y) FROM b) AS lift FROM b GROUP BY bin
    """,
    {"event_rate": 6, "lift": 6},
)
def _(t):
    return audit.decile_lift(t.loans, "Loan_Amount", "Default_Flag")


@query(
    "group_event_rate",
    "SELECT Segment, count(*) AS n, CAST(sum(Default_Flag) AS BIGINT) AS n_events, avg(Default_Flag) AS event_rate FROM loans GROUP BY 1",
    {"event_rate": 6},
)
def _(t):
    return audit.group_rate(t.loans, "Segment", "Default_Flag")


@query(
    "temporal_event_rate",
    """
    WITH m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_events,
        avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS event_rate FROM lineitem GROUP BY 1),
    s AS (SELECT CAST(unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH)) AS DATE) AS month)
    SELECT last_day(s.month) AS period_end, coalesce(n, 0) AS n, coalesce(n_events, 0) AS n_events, event_rate FROM s LEFT JOIN m USING (month)
    """,
    {"event_rate": 6},
)
def _(t):
    df = t.lineitem.withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    return audit.temporal_rate(df, "l_shipdate", "returned")


def _summary_sql(n):
    return f"""SELECT '{n}' AS "column", count({n}) AS count, avg({n}) AS mean, stddev_samp({n}) AS std, min({n}) AS min, quantile_cont({n}, 0.01) AS p01,
      quantile_cont({n}, 0.25) AS p25, quantile_cont({n}, 0.5) AS p50, quantile_cont({n}, 0.75) AS p75, quantile_cont({n}, 0.99) AS p99, max({n}) AS max,
      skewness({n}) AS skew, kurtosis({n}) AS kurtosis FROM lineitem"""


@query(
    "numeric_summary",
    " UNION ALL ".join(_summary_sql(n) for n in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    dict.fromkeys(("mean", "std", "min", "p01", "p25", "p50", "p75", "p99", "max"), 4) | {"skew": 6, "kurtosis": 6},
)
def _(t):
    return audit.numeric_summary(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query(
    "missingness",
    """WITH c AS (SELECT nullif(event_type, 'view') AS event_type, CASE WHEN value > 10 THEN value END AS value, user_id FROM events)
       SELECT 'event_type' AS "column", count(*) - count(event_type) AS missing FROM c UNION ALL SELECT 'value', count(*) - count(value) FROM c
       UNION ALL SELECT 'user_id', count(*) - count(user_id) FROM c""",
)
def _(t):
    return audit.missingness(t.events.select(
        F.nullif("event_type", F.lit("view")).alias("event_type"), F.when(F.col("value") > 10, F.col("value")).alias("value"), "user_id"))


@query(
    "duplicate_rows",
    """WITH d AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1)
       SELECT CAST(sum(k - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS k FROM d GROUP BY d)""",
)
def _(t):
    """Whole rows of a table that holds every order's first line twice."""
    return audit.duplicate_rows(t.lineitem.unionByName(t.lineitem.filter("l_linenumber = 1")))


@query(
    "key_uniqueness",
    """SELECT 'event_id' AS "column", count(*) AS n, count(DISTINCT event_id) AS n_distinct, count(*) = count(DISTINCT event_id) AS is_unique FROM events
       UNION ALL SELECT 'user_id', count(*), count(DISTINCT user_id), count(*) = count(DISTINCT user_id) FROM events""",
)
def _(t):
    return audit.key_uniqueness(t.events, ["event_id", "user_id"])


_NUM = ["Annual_Income", "Loan_Amount", "Collateral_Value", "Existing_Loan", "Interest_Rate", "Loan_Term_Months", "Credit_Score", "Employment_Length",
        "Debt_to_Income", "Past_Default", "Sector_Risk", "Default_Flag", "pd", "Total_Exposure", "Default_Alias", "Steady"]
_FEATURES = [n for n in _NUM if n != "Default_Flag"]


@query(
    "near_constant",
    f"""WITH k AS ({LEAKY}) SELECT * FROM ({" UNION ALL ".join(f"SELECT '{n}' AS column, stddev_samp({n}) / abs(avg({n})) AS cv FROM k" for n in _NUM)}) WHERE cv < 0.01""".replace(
        "AS column", 'AS "column"'),
    {"cv": 8},
)
def _(t):
    return audit.near_constant(leaky(t), {"Customer_ID"})


@query(
    "identity_scan",
    f"""WITH k AS ({LEAKY}) SELECT 'Loan_Amount' AS subject, 'Total_Exposure' AS left_operand, '-' AS operator, 'Existing_Loan' AS right_operand,
        max(abs(Loan_Amount - (Total_Exposure - Existing_Loan))) AS max_residual FROM k HAVING max_residual <= 0.05""",
    {"max_residual": 4},
)
def _(t):
    return audit.identity_scan(leaky(t), {"Customer_ID"})


def _corr_rows(columns, target, table):
    return " UNION ALL ".join(f"""SELECT '{n}' AS "column", corr({n}, {target}) AS corr FROM {table}""" for n in columns)


@query("target_alias_scan", f"WITH k AS ({LEAKY}) SELECT * FROM ({_corr_rows(_FEATURES, 'Default_Flag', 'k')}) WHERE abs(corr) >= 0.95", {"corr": 6})
def _(t):
    return audit.target_aliases(leaky(t), "Default_Flag", {"Customer_ID"})


@query(
    "correlation_ranking",
    f"WITH k AS ({LEAKY}) SELECT * FROM ({_corr_rows(_FEATURES, 'Default_Flag', 'k')}) ORDER BY abs(corr) DESC LIMIT 6",
    {"corr": 6},
)
def _(t):
    return audit.correlation_ranking(leaky(t), "Default_Flag", 6, {"Customer_ID"})


@query(
    "categorical_target_correlation",
    """WITH k AS (SELECT *, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS y FROM lineitem)
       SELECT 'l_quantity' AS "column", corr(l_quantity, y) AS corr FROM k UNION ALL SELECT 'l_extendedprice', corr(l_extendedprice, y) FROM k
       UNION ALL SELECT 'l_discount', corr(l_discount, y) FROM k""",
    {"corr": 6},
)
def _(t):
    return audit.target_correlation(t.lineitem.select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount"), "l_returnflag")


@query(
    "label_reconstruction",
    """
    WITH s AS (SELECT Price_Move_Class AS c, count(*) / (SELECT count(*) FROM tape) AS p FROM tape GROUP BY 1),
    cuts AS (SELECT sum(p) * ((SELECT count(*) FROM tape) - 1) AS pos FROM s WHERE c <= 'DOWN' UNION ALL SELECT sum(p) * ((SELECT count(*) FROM tape) - 1) FROM s WHERE c <= 'FLAT'),
    l AS (SELECT 'Trade_Volume' AS n, Trade_Volume AS v, Price_Move_Class AS y FROM tape UNION ALL SELECT 'OBI_Level1', OBI_Level1, Price_Move_Class FROM tape),
    o AS (SELECT n, v, row_number() OVER (PARTITION BY n ORDER BY v) - 1 AS r FROM l),
    ed AS (SELECT n, pos, max(CASE WHEN r = floor(pos) THEN v END) AS lo, max(CASE WHEN r = ceil(pos) THEN v END) AS hi FROM o, cuts GROUP BY 1, 2),
    e AS (SELECT n, list(lo + (hi - lo) * (pos - floor(pos))) AS edges FROM ed GROUP BY n),
    b AS (SELECT n, len(list_filter(edges, lambda x: x <= v)) AS bin, y FROM e JOIN l USING (n)),
    m AS (SELECT n, bin, max(k) AS hit, sum(k) AS k FROM (SELECT n, bin, y, count(*) AS k FROM b GROUP BY ALL) GROUP BY n, bin)
    SELECT n AS "column", sum(hit) / sum(k) AS agreement FROM m GROUP BY n
    """,
    {"agreement": 6},
)
def _(t):
    return audit.label_reconstruction(t.tape, "Price_Move_Class", ["Trade_Volume", "OBI_Level1"])


@query(
    "same_row_derivation",
    """WITH c AS (SELECT Return, Close / nullif(lag(Close) OVER (PARTITION BY Ticker ORDER BY Date), 0) - 1 AS ch FROM market)
       SELECT count(*) AS n, corr(Return, ch) AS corr FROM c WHERE ch IS NOT NULL""",
    {"corr": 6},
)
def _(t):
    return audit.same_row_derivation(t.market, "Return", ["Ticker"], ["Date"], "Close")


@query("temporal_span", "SELECT min(ts) AS first, max(ts) AS last, count(DISTINCT ts) AS n_distinct, count(*) AS n FROM events")
def _(t):
    return audit.temporal_span(t.events, "ts")


@query(
    "cv_power",
    """WITH c AS (SELECT CAST(sum(toxic) AS DOUBLE) AS p, count(*) AS n FROM labels),
       f AS (SELECT unnest([2, 5, 10]) AS n_splits),
       s AS (SELECT n_splits, p / n_splits AS pp, (n - p) / n_splits AS nn FROM c, f),
       r AS (SELECT *, CASE WHEN pp <= 1 OR nn <= 1 THEN 'Infinity'::DOUBLE ELSE sqrt((0.7 * (1 - 0.7) + (pp - 1) * (0.7 / 1.3 - 0.49) + (nn - 1) * (2 * 0.49 / 1.7 - 0.49)) / (pp * nn)) END AS se FROM s)
       SELECT CAST(n_splits AS INT) AS n_splits, pp AS positives_per_fold, se AS standard_error, se * 1.96 AS half_interval, se <= 0.05 AS passes FROM r""",
    {"positives_per_fold": 6, "standard_error": 6, "half_interval": 6},
)
def _(t):
    return audit.cv_power(t.labels, "toxic", [2, 5, 10])


_ADMISSIBLE = [n for n in _NUM if n not in ("Default_Flag", "Total_Exposure", "Default_Alias", "Steady", "pd")]


@query(
    "signal_strength",
    f"""WITH r AS (SELECT "column", abs(corr) AS a FROM ({_corr_rows(_ADMISSIBLE, 'Default_Flag', 'loans')}))
        SELECT max(a) AS strongest, max_by("column", a) AS "column", CASE WHEN max(a) < 0.05 THEN 'HIGH' ELSE 'INFO' END AS severity FROM r""",
    {"strongest": 6},
)
def _(t):
    return audit.signal_strength(t.loans.drop("pd"), specs.TABLES["loans"])


@query(
    "findings_report",
    f"""WITH k AS ({LEAKY}),
    a AS (SELECT * FROM ({_corr_rows(_FEATURES, 'Default_Flag', 'k')}))
    SELECT 'loans' AS dataset, 'missingness' AS "check", 'INFO' AS severity, '' AS columns, 0.0 AS measure
    UNION ALL SELECT 'loans', 'duplicates', 'INFO', '', 0.0
    UNION ALL SELECT 'loans', 'near_constant', 'INFO', 'Steady', stddev_samp(Steady) / avg(Steady) FROM k
    UNION ALL SELECT 'loans', 'arithmetic_identity', 'CRITICAL', 'Loan_Amount,Total_Exposure,Existing_Loan', max(abs(Loan_Amount - (Total_Exposure - Existing_Loan))) FROM k
    UNION ALL SELECT 'loans', 'identifier', 'INFO', 'Customer_ID', CAST(count(*) AS DOUBLE) FROM k
    UNION ALL SELECT 'loans', 'target_alias', 'CRITICAL', "column", corr FROM a WHERE abs(corr) >= 0.95
    UNION ALL SELECT 'loans', 'signal_strength', 'INFO', max_by("column", abs(corr)), max(abs(corr)) FROM a
    UNION ALL SELECT 'loans', 'class_balance', 'INFO', 'Default_Flag', greatest(sum(Default_Flag), count(*) - sum(Default_Flag)) / least(sum(Default_Flag), count(*) - sum(Default_Flag)) FROM k
    UNION ALL SELECT 'loans', 'cv_power', CASE WHEN se <= 0.05 THEN 'INFO' ELSE 'HIGH' END, 'Default_Flag', se FROM (SELECT sqrt((0.21 + (pp - 1) * (0.7 / 1.3 - 0.49) + (nn - 1) * (2 * 0.49 / 1.7 - 0.49)) / (pp * nn)) AS se
        FROM (SELECT sum(Default_Flag) / 5.0 AS pp, (count(*) - sum(Default_Flag)) / 5.0 AS nn FROM k))
    """,
    {"measure": 6},
)
def _(t):
    report = audit.findings(materialise(leaky(t), "loans"), specs.TABLES["loans"])
    key = F.element_at(F.map_values("evidence"), -1)
    return report.select("dataset", "check", "severity", F.concat_ws(",", "columns").alias("columns"), key.alias("measure"))


@query(
    "entity_overlap",
    """WITH k AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS key, 'orders' AS t FROM orders UNION SELECT DISTINCT CAST(c_custkey AS VARCHAR), 'customer' FROM customer
        UNION SELECT DISTINCT CAST(user_id AS VARCHAR), 'events' FROM events)
       SELECT a.t AS left_table, b.t AS right_table, count(*) AS n_shared FROM k a JOIN k b USING (key) GROUP BY ALL""",
)
def _(t):
    return audit.entity_overlap({"orders": (t.orders, "o_custkey"), "customer": (t.customer, "c_custkey"), "events": (t.events, "user_id")})


@query(
    "mean_distinct_per_group",
    "SELECT count(*) AS n_groups, avg(k) AS mean_distinct FROM (SELECT Device_ID, count(DISTINCT Customer_ID) AS k FROM transactions GROUP BY 1)",
    {"mean_distinct": 6},
)
def _(t):
    return audit.mean_distinct_per_group(t.transactions, "Device_ID", "Customer_ID")


@query(
    "top_values_per_column",
    """WITH v AS (SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2
         UNION ALL SELECT 'p_name', p_name, count(*) FROM part GROUP BY 2)
       SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM v QUALIFY rank <= 4""",
)
def _(t):
    counts = audit.value_counts(t.part, ["p_brand", "p_type", "p_name"])
    return audit.top_values(counts, 4).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "column_kinds",
    """SELECT 'o_orderkey' AS "column", 'numeric' AS kind, CAST(NULL AS BIGINT) AS n_distinct UNION ALL SELECT 'o_custkey', 'numeric', NULL UNION ALL SELECT 'o_totalprice', 'numeric', NULL
       UNION ALL SELECT 'o_orderstatus', CASE WHEN count(DISTINCT o_orderstatus) <= 4 THEN 'low_cardinality' ELSE 'high_cardinality' END, count(DISTINCT o_orderstatus) FROM orders
       UNION ALL SELECT 'o_orderpriority', CASE WHEN count(DISTINCT o_orderpriority) <= 4 THEN 'low_cardinality' ELSE 'high_cardinality' END, count(DISTINCT o_orderpriority) FROM orders""",
)
def _(t):
    return encode.column_kinds(t.orders, max_cardinality=4)


_TRAIN = "Timestamp < TIMESTAMP '2024-01-20 00:00:00' AND Device_ID <> '7'"


@query(
    "frequency_encoding",
    f"""WITH f AS (SELECT Device_ID, count(*) / (SELECT count(*) FROM transactions WHERE {_TRAIN}) AS fr FROM transactions WHERE {_TRAIN} GROUP BY 1)
        SELECT Transaction_ID, coalesce(fr, 0.0) AS device_frequency FROM transactions t LEFT JOIN f ON t.Device_ID = f.Device_ID""",
    {"device_frequency": 9},
)
def _(t):
    tx = t.transactions
    return encode.frequency_encode(tx, tx.filter(_TRAIN), "Device_ID", "device_frequency").select("Transaction_ID", "device_frequency")


@query(
    "smoothed_target_means",
    """SELECT Device_ID, count(*) AS n, (sum(Fraud_Flag) + 10.0 * (SELECT avg(Fraud_Flag) FROM transactions)) / (count(*) + 10.0) AS encoded,
       (SELECT avg(Fraud_Flag) FROM transactions) AS prior FROM transactions GROUP BY 1""",
    {"encoded": 8, "prior": 8},
)
def _(t):
    return encode.smoothed_means(t.transactions, "Device_ID", "Fraud_Flag")


@query(
    "target_encoding_lookup",
    f"""WITH tr AS (SELECT * FROM transactions WHERE {_TRAIN}), p AS (SELECT avg(Fraud_Flag) AS prior FROM tr),
        m AS (SELECT Device_ID, (sum(Fraud_Flag) + 10.0 * max(prior)) / (count(*) + 10.0) AS e FROM tr, p GROUP BY 1)
        SELECT Transaction_ID, coalesce(e, prior) AS device_rate FROM transactions t JOIN p ON true LEFT JOIN m ON t.Device_ID = m.Device_ID WHERE t.Timestamp >= TIMESTAMP '2024-01-20 00:00:00'""",
    {"device_rate": 8},
)
def _(t):
    tx = t.transactions
    new = tx.filter("Timestamp >= TIMESTAMP '2024-01-20 00:00:00'")
    return encode.target_encode(new, tx.filter(_TRAIN), "Device_ID", "Fraud_Flag", "device_rate").select("Transaction_ID", "device_rate")


@query(
    "out_of_fold_encoding",
    """WITH f AS (SELECT *, CAST(floor(@U(Transaction_ID,5)@ * 5) AS INT) AS fold FROM transactions),
       c AS (SELECT Device_ID, fold, count(*) AS n, sum(Fraud_Flag) AS s FROM f GROUP BY 1, 2),
       w AS (SELECT Device_ID, sum(n) AS n, sum(s) AS s FROM c GROUP BY 1), g AS (SELECT fold, sum(n) AS n, sum(s) AS s FROM c GROUP BY 1),
       p AS (SELECT fold, ((SELECT sum(s) FROM c) - s) / ((SELECT sum(n) FROM c) - n) AS prior FROM g)
       SELECT Transaction_ID, CASE WHEN w.n - c.n > 0 THEN (w.s - c.s + 10 * prior) / (w.n - c.n + 10) ELSE prior END AS device_rate
       FROM f JOIN c USING (Device_ID, fold) JOIN w USING (Device_ID) JOIN p USING (fold)""",
    {"device_rate": 8},
)
def _(t):
    df = t.transactions.withColumn("fold", encode.hashed_fold("Transaction_ID", 5, 5))
    return encode.out_of_fold_encode(df, "Device_ID", "Fraud_Flag", "fold", "device_rate").select("Transaction_ID", "device_rate")


_VAR = ["Past_Default", "Interest_Rate", "Customer_Type", "Steady_Flag", "Nearly"]


@query(
    "variance_filter",
    """WITH k AS (SELECT *, 1 AS Steady_Flag, CASE WHEN Customer_ID % 1000 = 0 THEN 'a' ELSE 'b' END AS Nearly FROM loans),
    """
    + "v AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS c, CAST({n} AS VARCHAR) AS v, count(*) AS k FROM k GROUP BY 2" for n in _VAR)
    + "), s AS (SELECT c, max(k) / sum(k) AS top_share FROM v GROUP BY 1), va AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS c, {f'(SELECT var_pop({n}) FROM k)' if n in ('Past_Default', 'Interest_Rate', 'Steady_Flag') else 'CAST(NULL AS DOUBLE)'} AS variance" for n in _VAR)
    + """) SELECT c AS "column", variance, top_share, CASE WHEN variance <= 1e-8 THEN 'variance' WHEN top_share >= 0.995 THEN 'dominance' ELSE 'kept' END AS verdict FROM s JOIN va USING (c)""",
    {"variance": 6, "top_share": 6},
)
def _(t):
    df = t.loans.withColumns({"Steady_Flag": F.lit(1), "Nearly": F.when(F.col("Customer_ID") % 1000 == 0, "a").otherwise("b")})
    return encode.variance_filter(df, _VAR)


_CORR = ["Annual_Income", "Loan_Amount", "Collateral_Value", "Total_Exposure", "Interest_Rate"]


@query(
    "correlation_matrix",
    f"WITH k AS ({LEAKY}) " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM k" for i, a in enumerate(_CORR) for b in _CORR[i + 1:]),
    {"corr": 6},
)
def _(t):
    return encode.correlation_matrix(leaky(t), _CORR)


#: The same greedy choice as a recursion over the ranked columns.
_CORR_FILTER_SQL = f"WITH RECURSIVE k AS ({LEAKY}), p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, coalesce(abs(corr({a}, {b})), 0) AS v FROM k" for i, a in enumerate(_CORR) for b in _CORR[i + 1:]) + """),
    m AS (SELECT a, b, v FROM p UNION ALL SELECT b, a, v FROM p),
    r AS (SELECT a AS c, row_number() OVER (ORDER BY a NOT IN ('Loan_Amount', 'Annual_Income'), sum(v), a) AS i, coalesce(list(b) FILTER (v >= 0.9), []) AS alike FROM m GROUP BY a),
    g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS chosen UNION ALL
          SELECT r.i, CASE WHEN list_has_any(chosen, alike) THEN chosen ELSE list_append(chosen, c) END FROM g JOIN r ON r.i = g.i + 1),
    f AS (SELECT arg_max(chosen, i) AS chosen FROM g)
    SELECT arg_max(b, v) AS kept, a AS dropped FROM m, f WHERE NOT list_contains(chosen, a) AND list_contains(chosen, b) GROUP BY a"""


@query(
    "correlation_filter",
    _CORR_FILTER_SQL,
)
def _(t):
    pairs = encode.correlation_filter(leaky(t), _CORR, threshold=0.9, priority={"Loan_Amount", "Annual_Income"})
    return t.spark.createDataFrame([(k, d) for d, k in pairs.items()], "kept string, dropped string")
