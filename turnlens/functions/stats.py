"""Statistics over counts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(k: Column, n: Column) -> Column:
    """k / n, null for n = 0."""
    return F.when(n > 0, k / n)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; (0, 0) for n = 0."""
    p = k / F.when(n > 0, n)
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    zero = lambda c: F.when(n > 0, c).otherwise(0.0)
    return zero(F.greatest(F.lit(0.0), centre - half)), zero(F.least(F.lit(1.0), centre + half))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (Abramowitz and Stegun 7.1.26, error below 1.5e-7)."""
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> tuple[Column, Column]:
    """Pooled z and two-sided p; (0, 1) where undefined."""
    p = (k1 + k2) / F.when((n1 > 0) & (n2 > 0), n1 + n2)
    se = F.sqrt(p * (1 - p) * (1 / F.when(n1 > 0, n1) + 1 / F.when(n2 > 0, n2)))
    z = F.coalesce((k1 / F.when(n1 > 0, n1) - k2 / F.when(n2 > 0, n2)) / F.when(se > 0, se), F.lit(0.0))
    return z, F.when(F.coalesce(se, F.lit(0.0)) > 0, erfc(F.abs(z) / F.sqrt(F.lit(2.0)))).otherwise(1.0)


def mcnemar(b: Column, c: Column) -> tuple[Column, Column]:
    """Continuity-corrected chi-square of discordant counts and its p; (0, 1) without any."""
    chi = F.when(b + c > 0, F.pow(F.abs(b - c) - 1, F.lit(2)) / F.when(b + c > 0, b + c)).otherwise(0.0)
    return chi, F.when(b + c > 0, erfc(F.sqrt(chi / 2))).otherwise(1.0)
