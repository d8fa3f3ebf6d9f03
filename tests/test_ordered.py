"""Cut groups must give the same answers as whole ones."""
import math
import random
import statistics
from bisect import insort

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import ordered as o


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of all rows; values repeat and are missing now and then."""
    rng = random.Random(7)
    rows = []
    for i in range(1200):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(30)}"
        rows.append((i, key, i // 2, None if rng.random() < 0.05 else round(rng.gauss(50, 20), 1)))
    return spark.createDataFrame(rows, "id long, k string, t long, v double").cache()


FEATURES = {
    "lag1": o.lag("v", 1), "lag7": o.lag("v", 7), "lead3": o.lead("v", 3),
    "m5": o.rolling("v", 5, "mean"), "s5": o.rolling("v", 5, "std"), "med5": o.rolling("v", 5, "median"),
    "hi10": o.rolling("v", 10, "max"), "lo4": o.rolling("v", 4, "min", 3), "n6": o.rolling("v", 6, "count"),
    "xm": o.expanding("v", "mean"), "xs": o.expanding("v", "std"), "xsum": o.expanding("v", "sum"),
    "xlo": o.expanding("v", "min"), "xhi": o.expanding("v", "max"), "xn": o.expanding("v", "count"),
    "rsum": o.running("v", "sum"), "rmax": o.running("v", "max"), "pos": o.prior_count(),
}


def close(a, b):
    if a is None or b is None:
        return a is b
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def table(df, key="id"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("by", [["k"], []])
def test_cut_groups_match_whole_groups(spark, skewed, by):
    whole = table(o.causal(skewed, by, ["t", "id"], FEATURES))
    spark.conf.set("spark.ledgerline.minSplitRows", "40")
    try:
        assert o.find_cut(skewed, by, "t") is not None
        cut = table(o.causal(skewed, by, ["t", "id"], FEATURES))
    finally:
        spark.conf.unset("spark.ledgerline.minSplitRows")
    assert whole.keys() == cut.keys()
    for key, row in whole.items():
        for name in FEATURES:
            assert close(row[name], cut[key][name]), (key, name, row[name], cut[key][name])


@pytest.mark.parametrize("by", [["k"], []])
@pytest.mark.parametrize("pct", [True, False])
def test_average_rank(spark, skewed, by, pct, request):
    import pandas as pd

    pdf = skewed.toPandas()
    want = (pdf.groupby("k")["v"] if by else pdf["v"]).rank(pct=pct)
    for rows in ("500000", "40"):
        spark.conf.set("spark.ledgerline.minSplitRows", rows)
        got = table(o.average_rank(skewed, by, "v", "r", pct))
        spark.conf.unset("spark.ledgerline.minSplitRows")
        for key, expected in zip(pdf["id"], want):
            value = got[key]["r"]
            assert value is None if pd.isna(expected) else math.isclose(value, expected)


def test_quantiles(spark, skewed):
    import numpy as np

    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    pdf = skewed.toPandas()
    want = np.percentile(pdf["v"].dropna(), [100 * p for p in probs])
    for rows in ("500000", "40"):
        spark.conf.set("spark.ledgerline.minSplitRows", rows)
        got = o.quantiles(skewed, "v", probs)
        grouped = table(o.group_quantiles(skewed, ["k"], "v", {"lo": 0.05, "hi": 0.95}), "k")
        spark.conf.unset("spark.ledgerline.minSplitRows")
        assert np.allclose(got, want)
        for key, part in pdf.groupby("k"):
            assert np.allclose([grouped[key]["lo"], grouped[key]["hi"]], np.percentile(part["v"].dropna(), [5, 95]))


def test_row_position_descending(spark, skewed):
    order = sorted((r for r in skewed.collect() if r.v is not None), key=lambda r: (-r.v, r.id))
    for rows in ("500000", "40"):
        spark.conf.set("spark.ledgerline.minSplitRows", rows)
        got = table(o.row_position(skewed.filter("v is not null"), ["v", "id"], "p", descending=True))
        spark.conf.unset("spark.ledgerline.minSplitRows")
        assert [got[r.id]["p"] for r in order] == list(range(len(order)))


def test_first_row_is_missing_and_groups_do_not_mix(spark):
    df = spark.createDataFrame([(k, i, float(i + 100 * (k == "B"))) for k in "AB" for i in range(50)], "k string, t int, v double")
    out = o.causal(df, ["k"], ["t"], {"p": o.lag("v"), "m": o.rolling("v", 5, "mean"), "n": o.lead("v", 2)})
    rows = {(r.k, r.t): r for r in out.collect()}
    assert rows["B", 0].p is None and rows["B", 0].m is None
    assert rows["B", 1].p == 100.0 and rows["A", 6].m == 3.0
    assert rows["A", 47].n == 49.0 and rows["A", 48].n is None


def test_invalid_requests():
    for make in (lambda: o.lag("v", 0), lambda: o.lead("v", 0), lambda: o.rolling("v", 0, "mean"), lambda: o.rolling("v", 3, "mode")):
        with pytest.raises(ValueError):
            make()


def test_plain_path_uses_one_exchange(skewed):
    plan = o.causal(skewed, ["k"], ["t", "id"], FEATURES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_row_position_when_one_value_holds_a_third(spark):
    rows = [(i, 5.0 if i % 3 == 0 else float(i % 50)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, v double")
    for down in (True, False):
        order = sorted(rows, key=lambda r: (-r[1] if down else r[1], r[0]))
        spark.conf.set("spark.ledgerline.minSplitRows", "40")
        got = table(o.row_position(df, ["v", "id"], "p", descending=down))
        spark.conf.unset("spark.ledgerline.minSplitRows")
        assert [got[r[0]]["p"] for r in order] == list(range(900))


def test_text_and_time_axes_are_cut_too(spark):
    rows = [(i, f"g{i * 7919 % 1000:04d}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, s string, t long").withColumn("ts", F.timestamp_seconds("t")).withColumn("ntz", F.col("ts").cast("timestamp_ntz"))
    spark.conf.set("spark.ledgerline.minSplitRows", "40")
    try:
        for column, key in (("s", lambda r: (r[1], r[0])), ("ts", lambda r: r[2]), ("ntz", lambda r: r[2])):
            assert o.find_cut(df, [], column) is not None
            got = table(o.row_position(df, [column, "id"], "p"))
            assert [got[r[0]]["p"] for r in sorted(rows, key=key)] == list(range(400))
    finally:
        spark.conf.unset("spark.ledgerline.minSplitRows")


@pytest.fixture(scope="module")
def holes(spark):
    """NULL and NaN order values, a hot NULL group, integers near 2^53 and beyond in sum, decimals, and text keys with one long prefix."""
    rng = random.Random(17)
    rows = []
    for i in range(600):
        key = None if i % 3 == 0 else f"g{rng.randrange(3)}"
        at = None if i % 40 == 0 else math.nan if i % 55 == 1 else float(rng.randrange(500))
        rows.append((i, key, at, (1 << 53) + rng.randrange(1000), f"a very long shared prefix {rng.randrange(10**6):06d}", None if i % 9 == 0 else rng.randrange(90)))
    df = spark.createDataFrame(rows, "id long, k string, t double, big long, name string, v int")
    return df.withColumn("dec", (F.col("v") / 100).cast("decimal(12,2)")).cache()


def both_ways(spark, make):
    """Schema and rows of a result below the size threshold and above it."""
    whole = make()
    first = (whole.dtypes, sorted(map(repr, whole.collect())))
    spark.conf.set("spark.ledgerline.minSplitRows", "40")
    try:
        cut = make()
        return first, (cut.dtypes, sorted(map(repr, cut.collect())))
    finally:
        spark.conf.unset("spark.ledgerline.minSplitRows")


@pytest.mark.parametrize("by", [["k"], []])
@pytest.mark.parametrize("order", ["t", "name"])
def test_cut_keeps_rows_types_and_digits(spark, holes, by, order):
    wanted = {
        "sum": o.expanding("big", "sum"), "rsum": o.running("big", "sum"), "dsum": o.expanding("dec", "sum"), "dmean": o.running("dec", "mean"),
        "lo": o.expanding("v", "min"), "n": o.expanding("v", "count"), "pos": o.prior_count(), "lag": o.lag("big", 2), "m": o.rolling("v", 4, "max"),
    }
    a, b = both_ways(spark, lambda: o.causal(holes, by, [order, "id"], wanted).select("id", *wanted))
    assert a[0] == b[0] and a[1] == b[1] and len(a[1]) == 600


@pytest.mark.parametrize("make", [
    lambda df: o.row_position(df, ["t", "id"], "at").select("id", "at"),
    lambda df: o.row_position(df, ["name", "id"], "at").select("id", "at"),
    lambda df: o.average_ranks(df, ["k"], {"r": "v"}).select("id", F.round("r", 9).alias("r")),
    lambda df: o.group_quantiles(df, ["k"], "v", {"q": 0.37}).withColumn("q", F.round("q", 9)),
])
def test_positions_ranks_and_quantiles_do_not_depend_on_size(spark, holes, make):
    a, b = both_ways(spark, lambda: make(holes))
    assert a == b


def test_a_shared_prefix_still_cuts(spark, holes, split_small):
    cut = o.find_cut(holes, [], "name")
    sizes = cut.hot(holes).groupBy("_slice").count().agg(F.max("count")).first()[0]
    assert sizes < 150


def test_null_groups_are_groups(spark, holes):
    from ledgerline.operators import features, metrics, portfolio

    df = holes.withColumn("y", (F.col("id") % 2).cast("double")).withColumn("s", F.col("v") / 90.0)
    assert metrics.ranking_metrics(df, "y", "s", ["k"]).count() == metrics.regression_metrics(df, "y", "s", ["k"]).count() == 4
    assert portfolio.historical_risk(df, ["k"], "s").count() == 4
    for bounded in (True, False):
        assert features.group_relative(df, ["k"], "s", "d", bounded).filter("d IS NULL").count() == df.filter("s IS NULL").count()


def test_sums_do_not_depend_on_cut_points(spark, monkeypatch):
    """Every bit of cumulative sums, means and deviations, with blocks smaller and larger than the slices and than the table."""
    rng = random.Random(8)
    rows = [(i, "hot" if i % 3 else f"k{rng.randrange(5)}", float(i // 2), None if i % 11 == 0 else rng.gauss(0, 1) * 10.0 ** rng.randrange(-9, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, k string, t double, v double")
    wanted = {
        "xs": o.expanding("v", "sum"), "xm": o.expanding("v", "mean", 3), "xd": o.expanding("v", "std"), "rs": o.running("v", "sum"),
        "rm": o.running("v", "mean"), "rd": o.running("v", "std"), "lag": o.lag("v", 2), "n": o.expanding("v", "count"),
    }
    sums = {}
    for block in (70, 256, 500_000):
        monkeypatch.setattr(o, "BLOCK", block)
        for by in (["k"], []):
            a, b = both_ways(spark, lambda: o.causal(df, by, ["t", "id"], wanted).select("id", *wanted))
            assert a[0] == b[0] and a[1] == b[1] and len(a[1]) == 900, (block, by)
            sums[block, len(by)] = table(o.causal(df, by, ["t", "id"], wanted))
    for n in (0, 1):
        for i, row in sums[500_000, n].items():
            assert all(close(row[c], sums[70, n][i][c]) for c in ("rs", "rm", "n", "lag"))
            assert all(row[c] is None and sums[70, n][i][c] is None or math.isclose(row[c], sums[70, n][i][c], rel_tol=1e-6) for c in ("xd", "rd"))


def test_later_rows_move_no_earlier_sum(spark, monkeypatch, split_small):
    """Damage to late rows moves the cut points; early sums keep every bit."""
    monkeypatch.setattr(o, "BLOCK", 90)
    rng = random.Random(9)
    df = spark.createDataFrame([(i, "a", float(i), rng.gauss(0, 1) * 10.0 ** rng.randrange(-9, 9)) for i in range(700)], "id long, k string, t double, v double")
    damaged = df.withColumns({"v": F.when(F.col("id") >= 400, -F.col("v") * 7 - 13).otherwise(F.col("v")), "t": F.when(F.col("id") >= 400, F.col("t") * 50).otherwise(F.col("t"))})
    wanted = {"s": o.expanding("v", "sum"), "m": o.running("v", "mean"), "d": o.expanding("v", "std")}
    early = lambda x: sorted(map(repr, o.causal(x, ["k"], ["t", "id"], wanted).where("id < 400").select("id", *wanted).collect()))
    assert early(df) == early(damaged)


@pytest.mark.parametrize("by", [["k"], []])
def test_running_medians_of_cut_groups(spark, skewed, split_small, by):
    """Order statistics over prefixes, found in steps over ranks, against sorting every prefix."""
    wanted = {"xm": o.expanding("v", "median", 9 if by else 1), "rm": o.running("v", "median"), "n": o.prior_count(), "m": o.expanding("v", "mean")}
    small = skewed.where("id < 210")
    got = table(o.causal(small, by, ["t", "id"], wanted))
    past = {}
    for r in sorted(small.collect(), key=lambda r: (r["t"], r["id"])):
        key, row = r["k"] if by else None, got[r["id"]]
        seen = past.setdefault(key, [])
        values = [v for v in seen if v is not None]
        upto = values + ([] if r["v"] is None else [r["v"]])
        assert row["n"] == len(seen)
        assert close(row["xm"], statistics.median(values) if len(values) >= (9 if by else 1) else None) and close(row["rm"], statistics.median(upto) if upto else None)
        seen.append(r["v"])
    assert len(got) == 210


@pytest.mark.parametrize("cut", [False, True])
def test_running_medians_take_one_pass(spark, cut):
    """No median is computed anew from all earlier rows: plain windows did that, and took the square of a group's size."""
    r = random.Random(8)
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 2.0, 2.0]
    rows = [(g, k, r.choice(odd) if k % 5 == 0 else r.choice([2.0, r.gauss(0, 9) + (k > 2000)])) for g, n in (("a", 4000), (None, 300)) for k in range(n)]
    spark.conf.set("spark.ledgerline.minSplitRows", "500" if cut else "500000")
    try:
        df = spark.createDataFrame(rows, "g string, k int, v double").withColumn("w", -F.col("v"))
        out = o.causal(df, ["g"], ["k"], {"xm": o.expanding("v", "median", 3), "rm": o.running("v", "median"), "wm": o.running("w", "median")})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "percentile" not in plan
        got = {(x.g, x.k): x for x in out.collect()}
    finally:
        spark.conf.unset("spark.ledgerline.minSplitRows")
    assert len(got) == len(rows)
    place = lambda x: (math.isnan(x), 0.0 if math.isnan(x) else x)

    def middle(seen, least=1):
        if len(seen) < least:
            return None
        low, high = seen[(len(seen) - 1) // 2], seen[len(seen) // 2]
        return low if low == high else low * 0.5 + high * 0.5

    same = lambda a, b: a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b)))
    for g in ("a", None):
        seen, back = [], []
        for _, k, v in (x for x in rows if x[0] == g):
            assert same(got[g, k].xm, middle(seen, 3)), k
            if v is not None:
                insort(seen, v, key=place)
                insort(back, -v, key=place)
            assert same(got[g, k].rm, middle(seen)) and same(got[g, k].wm, middle(back)), k
