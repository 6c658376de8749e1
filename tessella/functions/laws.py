"""Logs of factorials and the hypergeometric law as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to here factorials are exact longs; beyond, Stirling's series is exact to 1e-15.
EXACT = 20


def _series(x: Column) -> Column:
    return 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))


def log_factorial(n: Column) -> Column:
    """log(n!) of a long n >= 0."""
    x = F.greatest(n, F.lit(1)).cast("double")
    few = F.log(F.factorial(F.least(n, F.lit(EXACT)).cast("int")).cast("double"))
    return F.when(n <= EXACT, few).otherwise(x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + _series(x))


def log_falling(n: Column, t: Column) -> Column:
    """log(n (n-1) ... (n-t+1)) for 0 <= t <= n, without the difference of two large logs where t is small."""
    rest = n - t
    x, m = F.greatest(n, F.lit(1)).cast("double"), F.greatest(rest, F.lit(1)).cast("double")
    shrink = F.log1p(F.when(rest > 0, -t / x).otherwise(0.0))
    near = t * F.log(x) - (m + 0.5) * shrink - t + _series(x) - _series(m)
    return F.when(rest > EXACT, near).otherwise(log_factorial(n) - log_factorial(rest))


def hypergeometric(t: Column, total: Column, marked: Column, draws: Column) -> Column:
    """P(t of ``draws`` items drawn without replacement are among the ``marked`` of ``total``), for a possible t."""
    ways = log_falling(draws, t) - log_factorial(t)
    return F.exp(ways + log_falling(marked, t) + log_falling(total - marked, draws - t) - log_falling(total, draws))
