"""Scalar statistics that Spark lacks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function: a rational approximation of erfc with relative error below 1.2e-7."""
    # The published Chebyshev coefficients.
    terms = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    z = F.abs(x) / math.sqrt(2)
    t = 1.0 / (1.0 + 0.5 * z)
    poly = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        poly = F.lit(c) + t * poly
    tail = 0.5 * t * F.exp(-z * z + poly)
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b); null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.ln(F.try_divide(a, b)))


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating-point numbers have it: infinite, or NaN for 0 / 0, where ``b`` is 0."""
    b = b.cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def log_quotient(a: Column, b: Column) -> Column:
    """ln(a / b) as floating-point numbers have it: infinite where one is 0, NaN where both are or the signs differ."""
    q = quotient(a, b)
    return F.when(q > 0, F.ln(q)).when(q == 0, F.lit(float("-inf"))).when(q < 0, F.lit(float("nan")))


def round_scaled(x: Column, n: int) -> Column:
    """DuckDB's round of doubles: x times 10^n to the nearest whole number, halves away from zero, and back."""
    return F.round(x * F.lit(float(10**n))) / F.lit(float(10**n))


def ranks(value: Column, over_value, over_peers) -> Column:
    """Average ranks: ties share the mean of their places."""
    return F.rank().over(over_value) + (F.count(F.lit(1)).over(over_peers) - 1) / 2.0
