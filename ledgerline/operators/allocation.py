"""Capital allocation: inputs measured elsewhere, the best weights for many portfolios at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import specs

BUCKET_SCHEMA = "bucket string, expected_return double, volatility double, loss_rate double, low double, high double, capacity_crore double"


def bucket_defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(specs.BUCKET_DEFAULTS, BUCKET_SCHEMA)


def bucket_inputs(measured: DataFrame, portfolio: str | None = None, capital: float = specs.TOTAL_CAPITAL_CRORE) -> DataFrame:
    """Default inputs overlaid with measured ones; ``is_placeholder`` marks what was never measured.

    ``measured`` has ``bucket`` and any of the default columns; with ``portfolio`` there is one set
    of measurements per value of that column.
    """
    spark = measured.sparkSession
    defaults = F.broadcast(bucket_defaults(spark))  # eight fixed rows
    names = [n for n in ("expected_return", "volatility", "loss_rate", "low", "high") if n in measured.columns]
    keys = [portfolio] if portfolio else []
    values = measured.groupBy(*keys, "bucket").agg(*[F.max(n).alias(f"m_{n}") for n in names])
    if portfolio:
        spread = measured.select(portfolio).distinct().withColumn("_one", F.lit(0)).join(
            defaults.withColumn("_one", F.lit(0)), "_one").drop("_one")
    else:
        spread = bucket_defaults(spark)
    joined = spread.join(values, [*keys, "bucket"], "left")
    known = [F.col(f"m_{n}").isNotNull() for n in names]
    any_known = known[0]
    for k in known[1:]:
        any_known = any_known | k
    cap = F.when(F.col("capacity_crore").isNotNull(), F.col("capacity_crore") / capital)
    pick = lambda n: F.coalesce(F.col(f"m_{n}"), F.col(n)) if n in names else F.col(n)
    out = joined.select(
        *keys, "bucket", pick("expected_return").alias("expected_return"), pick("volatility").alias("volatility"),
        pick("loss_rate").alias("loss_rate"), pick("low").alias("low"), F.least(pick("high"), cap).alias("high"), (~any_known).alias("is_placeholder"))
    return out.withColumns({
        "net_return": F.col("expected_return") - F.col("loss_rate"),
        "risk_adjusted_return": (F.col("expected_return") - F.col("loss_rate")) / (F.col("volatility") + F.lit(specs.RATIO_FLOOR)),
    })


def _clip(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def _weights(nu: Column, lam: Column) -> Column:
    return F.transform("_b", lambda b: _clip((b["m"] - nu) / (lam * b["s"] * b["s"]), b["l"], b["h"]))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


#: How far the bounds of a portfolio may miss one in sum.
TOLERANCE = 1e-9


def _bounds(name: str) -> Column:
    return _sum(F.transform("_b", lambda b: b[name]))


def allocate(
    inputs: DataFrame, portfolio: str | None, scenarios: list[float], ceiling: float | None = 0.08, capital: float = specs.TOTAL_CAPITAL_CRORE,
    raises: int = 40, growth: float = 1.5,
) -> DataFrame:
    """Best weights of every portfolio for every risk aversion.

    Maximises net return minus half the risk aversion times the variance, with a diagonal
    covariance, weights summing to one and bounds per bucket.  The optimum has the closed form
    w = clip((m - nu) / (lambda s^2), l, h); nu is the point on a piecewise linear curve where
    the weights sum to one.  Risk aversion is raised until the volatility ceiling holds: all raised values
    are solved side by side and the first that fits is kept.

    A portfolio is one small array of its buckets; portfolios and scenarios are rows.  Bounds that cannot be
    met (lower ones above one in sum, or upper ones below) stop the job and name the portfolio.
    """
    keys = [portfolio] if portfolio else []
    buckets = F.sort_array(F.collect_list(F.struct(
        F.col("bucket").alias("n"), F.col("net_return").alias("m"), F.col("volatility").alias("s"), F.col("low").alias("l"),
        F.col("high").alias("h"), F.col("loss_rate").alias("d"))))
    df = inputs.groupBy(*keys).agg(buckets.alias("_b"))
    feasible = (_bounds("l") <= 1 + TOLERANCE) & (_bounds("h") >= 1 - TOLERANCE)
    name = F.coalesce(F.col(portfolio).cast("string"), F.lit("NULL")) if portfolio else F.lit("all")
    stop = F.raise_error(F.concat(F.lit("bounds that no weights summing to one satisfy: portfolio "), name)).cast("boolean")
    df = df.where(F.when(feasible, F.lit(True)).otherwise(stop)).withColumn("risk_aversion", F.explode(F.lit([float(s) for s in scenarios])))
    tries = F.transform(F.sequence(F.lit(0), F.lit(raises if ceiling is not None else 0)), lambda k: F.col("risk_aversion") * F.pow(F.lit(growth), k))
    df = df.select("*", F.posexplode(tries).alias("_try", "_lam"))
    lam = F.col("_lam")
    # The sum of weights falls piecewise linearly in nu; its corners are where a weight meets a bound.
    corner = lambda bound: F.transform("_b", lambda b: b["m"] - lam * b["s"] * b["s"] * b[bound])
    df = df.withColumn("_corners", F.array_sort(F.concat(corner("h"), corner("l"))))
    df = df.withColumn("_points", F.transform("_corners", lambda x: F.struct(x.alias("nu"), _sum(_weights(x, lam)).alias("total"))))
    df = df.withColumns({
        "_left": F.element_at(F.filter("_points", lambda p: p["total"] >= 1), -1),
        "_right": F.get(F.filter("_points", lambda p: p["total"] < 1), F.lit(0)),
    })
    left, right = F.col("_left"), F.col("_right")
    between = left["nu"] + (left["total"] - 1) / (left["total"] - right["total"]) * (right["nu"] - left["nu"])
    nu = F.when(right.isNull(), left["nu"]).when(left.isNull(), right["nu"]).otherwise(between)
    df = df.withColumn("_nu", nu)
    df = df.withColumn("_w", _weights(F.col("_nu"), lam))
    df = df.withColumn("_risk", F.sqrt(_sum(F.zip_with("_w", "_b", lambda w, b: w * w * b["s"] * b["s"]))))
    fits = F.lit(True) if ceiling is None else F.col("_risk") <= ceiling
    order = F.struct(F.when(fits, F.col("_try")).otherwise(raises + 1), -F.col("_try"))
    best = df.groupBy(*keys, "risk_aversion").agg(F.min_by(F.struct("_b", "_w", "_lam", "_risk"), order).alias("x"))
    long = best.select(*keys, "risk_aversion", "x._lam", "x._risk", F.explode(F.arrays_zip(F.col("x._b").alias("b"), F.col("x._w").alias("w"))).alias("e"))
    w, b = F.col("e.w"), F.col("e.b")
    return long.select(
        *keys, "risk_aversion", F.col("_lam").alias("effective_risk_aversion"), F.col("_risk").alias("portfolio_risk"), b["n"].alias("bucket"),
        w.alias("allocation_pct"), (w * capital).alias("allocation_crore"), (w * capital * b["m"]).alias("expected_profit_crore"),
        (w * capital * b["d"]).alias("expected_loss_crore"), b["l"].alias("low"), b["h"].alias("high"))


def binding_constraints(allocation: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Which weights sit on one of their bounds."""
    w = F.col("allocation_pct")
    state = F.when((F.abs(w - F.col("low")) < tolerance) & (F.col("low") > 0), "MINIMUM").when(
        (F.abs(w - F.col("high")) < tolerance) & (F.col("high") < 1), "MAXIMUM").otherwise("free")
    return allocation.withColumn("binding", state)


def allocation_summary(allocation: DataFrame, keys: list[str], capital: float = specs.TOTAL_CAPITAL_CRORE) -> DataFrame:
    """One row per portfolio and scenario."""
    return allocation.groupBy(*keys).agg(
        F.sum("allocation_pct").alias("total_weight"), (F.sum("expected_profit_crore") / capital).alias("portfolio_return"),
        F.max("portfolio_risk").alias("portfolio_risk"), F.sum("expected_profit_crore").alias("expected_profit_crore"),
        F.sum("expected_loss_crore").alias("expected_loss_crore"))


def measured_lending(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segment yields and loss rates as inputs of the two lending buckets."""
    name = F.when(F.col("Customer_Type") == "Corporate", "corporate_lending").otherwise("retail_lending")
    return segments.select(*keys, name.alias("bucket"), F.col("gross_yield").alias("expected_return"), F.col("ecl_rate").alias("loss_rate"))


