"""Raster expressions over one band stored as ``array<double>`` in row-major order.

Keeping a band in one row makes per-band work a projection: no explode, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(px: Column) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda s, v: s + v)


def mean(px: Column) -> Column:
    return total(px) / F.size(px)


def std_pop(px: Column) -> Column:
    """Population standard deviation, two passes over the row's own array."""
    def inner(m: Column) -> Column:
        return F.sqrt(F.aggregate(px, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(px))

    return F.get(F.transform(F.array(mean(px)), inner), F.lit(0))


def checksum(px: Column) -> Column:
    """Order-sensitive sum, used to compare whole rasters by one number."""
    return F.aggregate(
        F.transform(px, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v
    )


def percentile(sorted_px: Column, pct: float) -> Column:
    """Linear interpolation between closest ranks of an already sorted band."""
    pos = (F.size(sorted_px) - 1) * F.lit(pct / 100.0)
    low = F.floor(pos).cast("int")
    a = F.get(sorted_px, low)
    b = F.coalesce(F.get(sorted_px, low + 1), a)
    return a + (b - a) * (pos - low)


def stretch(px: Column, low: Column, high: Column, degenerate: int = 0, eps: float = 1e-6) -> Column:
    """Clip to [low, high] and scale to 0..255 with truncation; a flat band becomes the degenerate value."""
    span = high - low
    return F.when(
        span >= eps,
        F.transform(
            px,
            lambda v: F.floor((F.greatest(low, F.least(high, v)) - low) / F.nullif(span, F.lit(0.0)) * 255.0).cast(
                "int"
            ),
        ),
    ).otherwise(F.transform(px, lambda v: F.lit(degenerate)))


def percentile_stretch(
    px: Column, lo: float = 2.0, hi: float = 98.0, degenerate: int = 0, eps: float = 1e-6
) -> Column:
    """Sort once, read both percentiles from the sorted copy, stretch the original."""
    def with_bounds(s: Column) -> Column:
        return F.struct(percentile(s, lo).alias("lo"), percentile(s, hi).alias("hi"))

    bounds = F.transform(F.array(F.sort_array(px)), with_bounds)
    return F.get(F.transform(bounds, lambda b: stretch(px, b["lo"], b["hi"], degenerate, eps)), F.lit(0))


def minmax(px: Column, low: Column, high: Column) -> Column:
    span = high - low
    return F.when(
        span > 1e-8, F.transform(px, lambda v: (v - low) / F.nullif(span, F.lit(0.0)))
    ).otherwise(F.transform(px, lambda v: F.lit(0.0)))


def clip(px: Column, low: float, high: float) -> Column:
    return F.transform(px, lambda v: F.greatest(F.lit(low), F.least(F.lit(high), v)))


def normalized_difference(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b, lambda x, y: F.when(F.abs(x + y) > 1e-8, (x - y) / F.nullif(x + y, F.lit(0.0))).otherwise(F.lit(0.0))
    )


def to_db(px: Column) -> Column:
    """Linear backscatter to decibel when no value is negative; decibel input passes through. Our reading."""
    return F.when(
        F.array_min(px) >= 0, F.transform(px, lambda v: 10.0 * F.log10(F.greatest(v, F.lit(1e-10))))
    ).otherwise(px)
