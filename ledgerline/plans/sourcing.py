"""Reading, auditing, splitting and combining tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.scalar import uniform
from ..operators import splits
from ..operators.ordered import row_position
from ..session import fresh_dir
from ..sources import specs, tables
from .registry import query


@query(
    "csv_scan",
    "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total, min(o_orderdate) AS first FROM orders GROUP BY 1", {"total": 2},
)
def _(t):
    path = fresh_dir(t.spark, "orders-csv")
    t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "dd-MM-yyyy HH:mm")).write.option("header", True).csv(path)
    df = tables.read_csv(t.spark, path, t.orders.schema, {"o_orderdate": "dd-MM-yyyy HH:mm"})
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.min("o_orderdate").alias("first"))


@query("parquet_cache", "SELECT user_id, count(*) AS n, sum(value) AS total FROM events GROUP BY 1", {"total": 2})
def _(t):
    folder = fresh_dir(t.spark, "cache")
    build = lambda: t.events.select("event_id", "user_id", "value")
    tables.cached(t.spark, "events", t.path("events"), folder, build)
    again = tables.cached(t.spark, "events", t.path("events"), folder, lambda: (_ for _ in ()).throw(RuntimeError("built twice")))
    return again.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query(
    "datetime_parse",
    """SELECT 'day' AS "column", count(*) AS n, CAST(0 AS BIGINT) AS n_bad FROM orders UNION ALL
       SELECT 'mixed', count(*), count(*) FILTER (o_orderkey % 10 = 0) FROM orders""",
)
def _(t):
    df = t.orders.select(
        F.date_format("o_orderdate", "dd-MM-yyyy HH:mm").alias("day"),
        F.when(F.col("o_orderkey") % 10 == 0, "not a date").otherwise(F.date_format("o_orderdate", "dd-MM-yyyy")).alias("mixed"))
    return tables.parse_failures(df, {"day": "dd-MM-yyyy HH:mm", "mixed": "dd-MM-yyyy"})


@query(
    "narrowing_plan",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(min({c}) AS BIGINT) AS low, CAST(max({c}) AS BIGINT) AS high, CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint'
        WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS narrow_type FROM lineitem"""
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")),
)
def _(t):
    return tables.narrowing_plan(t.lineitem)


@query(
    "file_order",
    "SELECT l_suppkey, count(*) AS n, max(k) AS last_seq FROM (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, file_row_number) AS k FROM (SELECT *, row_number() OVER () AS file_row_number FROM lineitem)) GROUP BY 1",
)
def _(t):
    from ..operators.ordered import causal, prior_count

    df = tables.with_file_order(t.lineitem).select("l_suppkey", "l_shipdate", "seq")
    df = causal(df, ["l_suppkey"], ["l_shipdate", "seq"], {"k": prior_count()})
    return df.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), (F.max("k") + 1).alias("last_seq"))


def _loan_spec():
    return replace(specs.TABLES["loans"], expected_rows=15000, expected_cols=17, positive_rate=0.3289)


AUDIT_SQL = """SELECT 'loans' AS dataset, count(*) AS rows, 17 AS cols, true AS has_target, avg(Default_Flag) AS positive_rate, count(*) = 15000 AS rows_ok, true AS cols_ok,
   abs(avg(Default_Flag) - 0.3289) <= 5e-4 AS rate_ok, count(*) = 15000 AND abs(avg(Default_Flag) - 0.3289) <= 5e-4 AS schema_ok FROM loans"""


@query("schema_audit", AUDIT_SQL, {"positive_rate": 6})
def _(t):
    return tables.schema_audit(t.loans, _loan_spec())


@query(
    "dataset_overview",
    f"""{AUDIT_SQL} UNION ALL SELECT 'liquidity', count(*), 11, true, NULL, count(*) = 1216, false, true, false FROM liquidity""", {"positive_rate": 6},
)
def _(t):
    return tables.overview({"loans": (t.loans, _loan_spec()), "liquidity": (t.liquidity, specs.TABLES["liquidity"])})


@query("file_manifest")
def _(t):
    return tables.file_manifest(t.spark, t.path("lineitem"))


@query("table_digest")
def _(t):
    return tables.table_digest(t.lineitem)


@query(
    "feature_sink",
    "SELECT o_orderpriority, year(o_orderdate) AS year, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE year(o_orderdate) = 1997 GROUP BY ALL", {"total": 2},
)
def _(t):
    path = fresh_dir(t.spark, "features")
    tables.write_features(t.orders.withColumn("year", F.year("o_orderdate").cast("bigint")), path, ["year"])
    back = t.spark.read.parquet(path).filter("year = 1997")
    return back.groupBy("o_orderpriority", F.col("year").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query(
    "report_sink", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1",
)
def _(t):
    path = fresh_dir(t.spark, "report")
    tables.write_report(t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), path)
    return t.spark.read.schema("c_mktsegment string, n bigint").option("header", True).csv(path)


@query(
    "run_log",
    """SELECT 'first' AS run, event_type AS model, avg(value) AS value, CAST(NULL AS BIGINT) AS n FROM events GROUP BY event_type
       UNION ALL SELECT 'second', event_type, max(value), count(*) FROM events GROUP BY event_type""",
    {"value": 6},
)
def _(t):
    a, b = fresh_dir(t.spark, "runs"), fresh_dir(t.spark, "runs")
    by = t.events.groupBy(F.col("event_type").alias("model"))
    tables.append_runs(by.agg(F.avg("value").alias("value")).withColumn("run", F.lit("first")), a)
    tables.append_runs(by.agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n")).withColumn("run", F.lit("second")), b)
    return tables.read_runs(t.spark, a, b).select("run", "model", "value", "n")


@query(
    "leak_free_projection",
    """SELECT count(*) AS n, sum(Loan_Amount) AS loan_total, CAST(sum(label) AS BIGINT) AS positives FROM (SELECT * EXCLUDE (Customer_ID, Default_Flag, pd), Default_Flag AS label FROM loans)""",
    {"loan_total": 2},
)
def _(t):
    df = tables.feature_frame(t.loans, specs.TABLES["loans"], extra_drop=("pd",))
    assert not {"Customer_ID", "Default_Flag", "pd"} & set(df.columns)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum("Loan_Amount").alias("loan_total"), F.sum("label").alias("positives"))


@query(
    "scoring_contract", "SELECT Credit_Score, Loan_Amount FROM loans WHERE Debt_to_Income > 0.9", {"Loan_Amount": 2},
)
def _(t):
    return tables.check_contract(t.loans.filter("Debt_to_Income > 0.9"), ["Credit_Score", "Loan_Amount"], strict=False)


# ----------------------------------------------------------------------------------------------
# Set operations
# ----------------------------------------------------------------------------------------------
@query(
    "union_by_name",
    "SELECT nation, kind, sum(balance) AS balance, count(extra) AS extras FROM (SELECT c_nationkey AS nation, 'c' AS kind, c_acctbal AS balance, c_mktsegment AS extra FROM customer UNION ALL SELECT s_nationkey, 's', s_acctbal, NULL FROM supplier) GROUP BY 1, 2",
    {"balance": 2},
)
def _(t):
    c = t.customer.select(F.col("c_nationkey").alias("nation"), F.lit("c").alias("kind"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("extra"))
    s = t.supplier.select(F.lit("s").alias("kind"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s, allowMissingColumns=True).groupBy("nation", "kind").agg(F.sum("balance").alias("balance"), F.count("extra").alias("extras"))


@query("key_intersection", "SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def _(t):
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.events.select("user_id"))


@query("distinct_ordered_keys", "SELECT l_shipdate AS day, dense_rank() OVER (ORDER BY l_shipdate) - 1 AS place FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem)")
def _(t):
    from ..operators.ordered import row_position

    return row_position(t.lineitem.select(F.to_date("l_shipdate").alias("day")).distinct(), ["day"], "place")


# ----------------------------------------------------------------------------------------------
# Splits
# ----------------------------------------------------------------------------------------------
def _growing_sql(n, n_splits, first, gap):
    size = f"(({n} - {first} - {gap}) // {n_splits})"
    return f"""SELECT f AS fold, {first} + (f - 1) * {size} AS train_end, {first} + (f - 1) * {size} + {gap} AS test_start,
       CASE WHEN f = {n_splits} THEN {n} ELSE {first} + (f - 1) * {size} + {gap} + {size} END AS test_end FROM (SELECT unnest(range(1, {n_splits + 1})) AS f)"""


PURGED = f"""
ax AS (SELECT *, dense_rank() OVER (ORDER BY Date) - 1 AS a FROM market), fs AS ({_growing_sql('(SELECT count(DISTINCT Date) FROM market)', 6, 60, 5)}),
asg AS (SELECT Date, Ticker, CAST(fold AS INT) AS fold, CASE WHEN a < train_end THEN 'train' ELSE 'test' END AS role FROM ax JOIN fs ON a < train_end OR (a >= test_start AND a < test_end))
"""


def _purged(t):
    df, folds = splits.purged_walk_forward(t.market.select("Date", "Ticker"), "Date", 6, 5, 60)
    return splits.assign(df, folds, ["Date", "Ticker"])


@query("purged_walk_forward", f"WITH {PURGED} SELECT * FROM asg")
def _(t):
    return _purged(t)


@query(
    "describe_folds",
    f"""WITH {PURGED} SELECT fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, max(Date) FILTER (role = 'train') AS train_end,
      min(Date) FILTER (role = 'test') AS test_start, max(Date) FILTER (role = 'test') AS test_end, CAST(min(Date) FILTER (role = 'test') - max(Date) FILTER (role = 'train') AS INT) AS gap_days FROM asg GROUP BY fold""",
)
def _(t):
    return splits.describe_folds(_purged(t), "Date")


@query("temporal_overlap_check", "SELECT CAST(NULL AS INT) AS fold, CAST(NULL AS DATE) AS train_end, CAST(NULL AS DATE) AS test_start, CAST(NULL AS BIGINT) AS gap FROM lineitem WHERE false")
def _(t):
    return splits.temporal_overlap(_purged(t), "Date", embargo=5)


@query(
    "temporal_overlap_found",
    f"""WITH {PURGED} SELECT fold, max(Date) AS train_end, min(Date) AS test_start, CAST(0 AS BIGINT) AS gap FROM asg WHERE role = 'test' AND fold % 2 = 0 GROUP BY fold""",
)
def _(t):
    """Every second fold also trains on its own test rows."""
    good = _purged(t)
    return splits.temporal_overlap(good.unionByName(good.filter("role = 'test' AND fold % 2 = 0").withColumn("role", F.lit("train"))), "Date", embargo=5)


@query(
    "walk_forward_by_group",
    """WITH ax AS (SELECT seq, Trading_Day, Timestamp, dense_rank() OVER (ORDER BY Trading_Day) - 1 AS a FROM tape),
    r AS (SELECT seq, CASE WHEN a < 12 THEN 'train' WHEN a < 16 THEN 'validation' WHEN a < 20 THEN 'test' END AS role, row_number() OVER (PARTITION BY a < 12 ORDER BY Trading_Day DESC, Timestamp DESC, seq DESC) AS back FROM ax)
    SELECT seq, role FROM r WHERE role IS NOT NULL AND NOT (role = 'train' AND back <= 3)""",
)
def _(t):
    return splits.walk_forward_by_group(t.tape.select("seq", "Trading_Day", "Timestamp"), "Trading_Day", ["Timestamp", "seq"], purge=3).select("seq", "role")


@query(
    "expanding_window",
    f"""WITH ax AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS a FROM events), fs AS ({_growing_sql('(SELECT count(*) FROM events)', 5, 250, 5)})
    SELECT event_id, CAST(fold AS INT) AS fold, CASE WHEN a < train_end THEN 'train' ELSE 'test' END AS role FROM ax JOIN fs ON a < train_end OR (a >= test_start AND a < test_end)""",
)
def _(t):
    df, folds = splits.expanding_window(t.events.select("event_id", "ts"), ["ts", "event_id"])
    return splits.assign(df, folds, ["event_id"])


@query(
    "time_series_split",
    """WITH ax AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS a FROM events), n AS (SELECT count(*) AS n, count(*) // 6 AS size FROM events),
    fs AS (SELECT f AS fold, n - (5 - (f - 1)) * size AS s, size FROM n, (SELECT unnest(range(1, 6)) AS f))
    SELECT event_id, CAST(fold AS INT) AS fold, CASE WHEN a < s THEN 'train' ELSE 'test' END AS role FROM ax JOIN fs ON a < s + size""",
)
def _(t):
    df, folds = splits.time_series_split(t.events.select("event_id", "ts"), ["ts", "event_id"])
    return splits.assign(df, folds, ["event_id"])


@query(
    "chronological_holdout",
    "SELECT CASE WHEN ts < TIMESTAMP '2024-01-24 00:00:00' THEN 'train' ELSE 'holdout' END AS role, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1",
)
def _(t):
    return splits.holdout_by_time(t.events, "ts", dt.datetime(2024, 1, 24)).groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


STRAT = """
st AS (SELECT doc_id, toxic, CAST(rep AS INT) AS repeat, ntile(5) OVER (PARTITION BY toxic, rep ORDER BY CAST(('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), CAST(rep AS VARCHAR), '42')), 1, 13)) AS BIGINT) / 4503599627370496, doc_id) AS fold
   FROM labels, (SELECT unnest([1, 2, 3]) AS rep))
"""


@query("stratified_folds", f"WITH {STRAT} SELECT doc_id, toxic, repeat, CAST(fold AS INT) AS fold FROM st")
def _(t):
    return splits.stratified_folds(t.labels, "doc_id", "toxic", 5, 3)


@query("stratified_fold_balance", f"WITH {STRAT} SELECT repeat, CAST(fold AS INT) AS fold, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS positives FROM st GROUP BY 1, 2")
def _(t):
    return splits.stratified_folds(t.labels, "doc_id", "toxic", 5, 3).groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("positives"))


GROUPED = """SELECT Option_ID, Underlying, year(Expiry) || 'Q' || quarter(Expiry) AS q,
   CAST(floor(CAST(('0x' || substr(md5(concat_ws(':', Underlying, year(Expiry) || 'Q' || quarter(Expiry), '42')), 1, 13)) AS BIGINT) / 4503599627370496 * 5) + 1 AS INT) AS fold FROM options"""


def _grouped(t):
    from ..functions.scalar import quarter_label

    return t.options.select("Option_ID", "Underlying", quarter_label("Expiry").alias("q")).withColumn("fold", splits.group_fold(["Underlying", "q"]))


@query("group_folds", f"SELECT Option_ID, fold FROM ({GROUPED})")
def _(t):
    return _grouped(t).select("Option_ID", "fold")


@query("group_overlap_check", f"SELECT CAST(NULL AS INT) AS fold, CAST(NULL AS VARCHAR) AS Underlying, CAST(NULL AS VARCHAR) AS q FROM ({GROUPED}) WHERE false")
def _(t):
    g = _grouped(t).withColumnRenamed("fold", "home")
    rows = g.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("role", F.when(F.col("home") == F.col("fold"), "test").otherwise("train"))
    return splits.group_overlap(rows, ["Underlying", "q"])


@query(
    "group_overlap_found",
    f"""WITH g AS (SELECT Underlying, q, CAST(floor(@U(Option_ID,3)@ * 5) AS INT) + 1 AS home FROM ({GROUPED})), f AS (SELECT CAST(unnest(range(1, 6)) AS INT) AS fold)
        SELECT fold, Underlying, q FROM g, f GROUP BY 1, 2, 3 HAVING count(*) FILTER (home = fold) BETWEEN 1 AND count(*) - 1""",
)
def _(t):
    """Folds dealt by row, so that groups are torn apart."""
    g = _grouped(t).withColumn("home", F.floor(uniform("Option_ID", 3) * 5).cast("int") + 1).drop("fold")
    rows = g.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("role", F.when(F.col("home") == F.col("fold"), "test").otherwise("train"))
    return splits.group_overlap(rows, ["Underlying", "q"])


@query(
    "fold_coverage_found",
    "SELECT doc_id, CAST(CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_tests FROM labels WHERE (doc_id % 11 = 0) = (doc_id % 7 <> 0)",
)
def _(t):
    """Some rows are never tested, some twice."""
    f = splits.stratified_folds(t.labels, "doc_id", "toxic", 5)
    tests = f.filter("doc_id % 7 <> 0").unionByName(f.filter("doc_id % 11 = 0")).withColumn("role", F.lit("test"))
    return splits.coverage(tests.unionByName(f.withColumn("role", F.lit("train"))), "doc_id")


@query(
    "null_key_position",
    """SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 7 <> 0 THEN ts END NULLS FIRST, event_id) - 1 AS position FROM events""",
)
def _(t):
    """Positions of a table whose order column is missing in every seventh row."""
    return row_position(t.events.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts")), ["ts", "event_id"], "position").drop("ts")


@query("fold_coverage_check", "SELECT doc_id, CAST(0 AS BIGINT) AS n_tests FROM labels WHERE false")
def _(t):
    f = splits.stratified_folds(t.labels, "doc_id", "toxic", 5).withColumnRenamed("fold", "home")
    rows = f.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("role", F.when(F.col("home") == F.col("fold"), "test").otherwise("train"))
    return splits.coverage(rows, "doc_id")


@query("date_semi_join", "SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE event_type = 'error' AND value > 100) GROUP BY 1")
def _(t):
    day = F.to_date("ts").alias("d")
    picked = t.events.filter("event_type = 'error' AND value > 100").select(day).distinct()
    return t.events.select("event_type", day).join(picked, "d", "left_semi").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "uniform_fold_share",
    "SELECT CAST(floor(@U(event_id,9)@ * 4) AS INT) AS fold, count(*) AS n FROM events GROUP BY 1",
)
def _(t):
    return t.events.groupBy(F.floor(uniform("event_id", 9) * 4).cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


