"""Statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by the rational approximation 7.1.26 of Abramowitz and Stegun (error under 1.5e-7)."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-z * z)
    return F.when(x >= 0, 1 - half).otherwise(half)


def below(threshold: float, mu: Column, sigma: Column) -> Column:
    """Probability that a normal value is below threshold; sigma 0 is a step."""
    safe = F.when(sigma > 0, sigma)
    return F.coalesce(normal_cdf((F.lit(threshold) - mu) / safe), F.when(mu < threshold, 1.0).otherwise(0.0))


def logit(p: Column, low: float = 0.001) -> Column:
    """Log odds of p, held within [low, 1 - low]."""
    c = F.greatest(F.least(p, F.lit(1 - low)), F.lit(low))
    return F.ln(c / (1 - c))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    """cos and sin of a cyclic position."""
    a = x * (2 * math.pi / period)
    return F.cos(a), F.sin(a)


def harmonics(doy: Column, year: float = 365.0) -> list[Column]:
    """1 and two harmonics of the day of year."""
    w = doy * (2 * math.pi / year)
    return [F.lit(1.0), F.cos(w), F.sin(w), F.cos(2 * w), F.sin(2 * w)]


def per_step(p: Column, steps: int) -> Column:
    """Weekly probability as that of each of its steps."""
    return 1 - F.pow(F.greatest(F.least(1 - p, F.lit(1.0)), F.lit(0.0)), F.lit(1.0 / steps))


def scaled(x: Column, low: Column, high: Column) -> Column:
    """x within 0 to 1 of its range; a constant has range 1."""
    return (x - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))


def variance_scaled(f: Column, fm: Column, fs: Column, om: Column, os: Column) -> Column:
    """Forecast f with the hindcasts' mean and deviation (fm, fs) put at the observations' (om, os); next to no deviation: the mean is shifted only."""
    return F.when(fs < 1e-6, f - fm + om).otherwise((f - fm) / F.nullif(fs, F.lit(0.0)) * os + om)


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def celsius(kelvin: Column) -> Column:
    """Kelvin as degrees Celsius."""
    return kelvin - 273.15
