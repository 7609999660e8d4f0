"""Numeric expressions: exact rounding and bounded ramps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_scaled(value: Column, scale: Column) -> Column:
    """``value * scale`` rounded to a whole number by its exact value, ties to even.

    Spark's ``round`` works on the shortest decimal text, so 0.2875 (stored as
    0.28749999...) would go up. Here the rounding error of the product is
    computed exactly (the double is split in two halves) and decides the tie.
    ``scale`` is a power of ten up to 10^11.
    """
    scaled = value * scale
    spread = value * F.lit(134217729.0)
    high = spread - (spread - value)
    error = (high * scale - scaled) + (value - high) * scale
    floor = scaled - F.pmod(scaled, F.lit(1.0))
    rest = scaled - floor
    odd = F.pmod(floor, F.lit(2.0)) == 1.0
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & odd)))
    return floor + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))


def round3(value: Column) -> Column:
    """Round to 3 places, see :func:`exact_scaled`."""
    return exact_scaled(value, F.lit(1000.0)) / F.lit(1000.0)


def number_text(value: Column) -> Column:
    """Six significant digits without trailing zeros, as C's ``%g`` prints."""
    size = F.abs(value)
    scale = F.pow(F.lit(10.0), F.lit(5.0) - F.floor(F.log10(size)))
    cut = F.when((size >= 1e-4) & (size < 1e6), exact_scaled(value, scale) / scale).otherwise(value)
    printed = F.format_string("%.6g", cut)
    trimmed = F.regexp_replace(printed, r"(\.\d*?)0+(e|$)", "$1$2")
    return F.regexp_replace(trimmed, r"\.(e|$)", "$1")


def percent_text(value: Column) -> Column:
    """A percentage without decimals, ties to even."""
    return F.rint(value).cast("bigint").cast("string")


def lower_is_better(value: Column, good: float, cutoff: float, most: float) -> Column:
    """``most`` points up to ``good``, none from ``cutoff``, linear between; NULL gives 0."""
    span = cutoff - good
    ramp = (F.lit(most) * ((F.lit(cutoff) - value) / F.lit(span))) if span > 0 else F.lit(0.0)
    return (
        F.when(value.isNull(), F.lit(0.0)).when(value <= good, F.lit(most))
        .when(value >= cutoff, F.lit(0.0)).otherwise(ramp)
    )


def higher_is_better(value: Column, least: float, target: float, most: float) -> Column:
    """No points up to ``least``, ``most`` from ``target``, linear between; NULL gives 0."""
    span = target - least
    ramp = (F.lit(most) * ((value - F.lit(least)) / F.lit(span))) if span > 0 else F.lit(0.0)
    return (
        F.when(value.isNull(), F.lit(0.0)).when(value <= least, F.lit(0.0))
        .when(value >= target, F.lit(most)).otherwise(ramp)
    )
