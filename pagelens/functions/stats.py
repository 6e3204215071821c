"""Closed-form estimate expressions."""

from pyspark.sql import Column, functions as F

from pagelens.functions.fixed_values import Z_95


def wilson(k: Column, n: Column, z: float = Z_95) -> tuple:
    """AGG-15: Wilson score interval for ``k`` of ``n``; (0, 0) when n is 0."""
    n_d = F.nullif(n.cast("double"), F.lit(0.0))
    p = k.cast("double") / n_d
    denom = 1 + z * z / n_d
    centre = (p + z * z / (2 * n_d)) / denom
    spread = p * (1 - p) / n_d + z * z / (4 * n_d * n_d)
    margin = z * F.sqrt(spread) / denom
    low = F.greatest(F.lit(0.0), centre - margin)
    high = F.least(F.lit(1.0), centre + margin)
    empty = n == 0
    return F.when(empty, 0.0).otherwise(low), F.when(empty, 0.0).otherwise(high)


def per(total: Column, count: Column) -> Column:
    """Ratio whose denominator is at least one."""
    return total.cast("double") / F.greatest(F.lit(1), count)
