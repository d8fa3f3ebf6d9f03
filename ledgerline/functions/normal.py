"""Normal distribution as column expressions; nothing leaves generated code.

The distribution function is the double-precision rational form of Hart (1968) as given by
West, "Better approximations to cumulative normal functions" (2005).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col

# Published coefficients, highest power first.
HART_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
HART_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
HART_SWITCH = 7.07106781186547
SQRT_TWO_PI = 2.506628274631


def _horner(coefficients, x: Column) -> Column:
    total = F.lit(coefficients[0])
    for value in coefficients[1:]:
        total = total * x + F.lit(value)
    return total


def norm_pdf(x) -> Column:
    x = col(x)
    return F.exp(F.lit(-0.5) * x * x) / F.lit(math.sqrt(2 * math.pi))


def norm_cdf(x) -> Column:
    x = col(x)
    a = F.abs(x)
    decay = F.exp(F.lit(-0.5) * a * a)
    fraction = F.lit(0.65) + a
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    tail = F.when(
        a < F.lit(HART_SWITCH), decay * _horner(HART_NUMERATOR, a) / _horner(HART_DENOMINATOR, a)
    ).otherwise(decay / fraction / F.lit(SQRT_TWO_PI))
    # One mention of the long expression: 1 - tail above zero, tail below.
    above = F.when(x > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return above + (F.lit(1.0) - 2 * above) * tail


def erfc(x) -> Column:
    """Complementary error function of a non-negative argument."""
    return F.lit(2.0) * norm_cdf(-(col(x) * F.lit(math.sqrt(2.0))))


def norm_ppf(p: float) -> float:
    """Standard normal quantile of one constant probability."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)
