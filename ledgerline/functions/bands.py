"""Banding of numbers into labels or bin indexes with an explicit closure rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col


def band(x, edges: list[float], labels: list[str], closed: str = "right", default: str | None = None) -> Column:
    """Label of the interval a value lies in; NULL (or ``default``) outside all of them."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval is needed")
    x = col(x)
    chain = None
    for low, high, label in zip(edges, edges[1:], labels):
        inside = (x > low) & (x <= high) if closed == "right" else (x >= low) & (x < high)
        chain = F.when(inside, label) if chain is None else chain.when(inside, label)
    return chain if default is None else chain.otherwise(default)


def count_edges(x: Column, edges: list[float], passed) -> Column:
    """Number of edges a value has passed; a plain sum, so it stays in generated code."""
    return reduce(lambda a, b: a + b, [passed(x, F.lit(float(e))).cast("int") for e in edges], F.lit(0))


def bin_right_closed(x, edges: list[float]) -> Column:
    """1-based bin of right-closed intervals whose lowest edge is included."""
    x = col(x)
    below = count_edges(x, edges, lambda value, edge: value > edge)
    return F.when(x.isNotNull(), F.greatest(below, F.lit(1))).cast("int")


def bin_left_closed(x, edges: list[float]) -> Column:
    """1-based bin of left-closed intervals whose last edge is included; outside values are clipped."""
    x = col(x)
    reached = count_edges(x, edges, lambda value, edge: value >= edge)
    clipped = F.least(F.greatest(reached, F.lit(1)), F.lit(len(edges) - 1))
    return F.when(x.isNotNull(), clipped).cast("int")
