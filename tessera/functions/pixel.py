"""Pixel algebra as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_type(bits: int) -> str:
    """The smallest unsigned container for a sensor depth of 1..64 bits."""
    if not 1 <= bits <= 64:
        raise ValueError(f"sensor depth must be 1..64 bits, not {bits}")
    return next(f"uint{n}" for n in (8, 16, 32, 64) if bits <= n)


def to_8bit(dn: Column, bits: int) -> Column:
    """The working 8-bit view: the depth's excess is divided away, then wraps like a byte."""
    return F.pmod(F.floor(dn / F.lit(float(2**bits / 256))), F.lit(256)).cast("int")


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma 0.299 / 0.587 / 0.114 in 14-bit fixed point, rounded."""
    return F.floor((r * 4899 + g * 9617 + b * 1868 + 8192) / F.lit(16384.0)).cast("int")


def binary(v: Column) -> Column:
    return F.when(v > 0, 1).otherwise(0)


def clouded(code: Column) -> Column:
    """Mosaicking: codes above 2 are cloud."""
    return F.when(code > 2, 1).otherwise(0)


def clear_for_fill(code: Column) -> Column:
    """Cloud filling: codes below 10 are clear."""
    return F.when(code < 10, 1).otherwise(0)


def to_12bit(raw: Column, offset: int) -> Column:
    """Shifted and clipped to 1..4095; 0 stays no-data."""
    return F.when(raw == 0, 0).otherwise(F.least(F.greatest(raw - offset, F.lit(1)), F.lit(4095)))


def in_classes(v: Column, classes: tuple[int, ...] = (3, 8, 9, 10)) -> Column:
    return F.when(v.isin(*classes), 1).otherwise(0)


def pseudo_pan(*bands: Column) -> Column:
    """Mean of the visible bands; 0 where one has no data."""
    total = bands[0]
    for b in bands[1:]:
        total = total + b
    return F.when(F.least(*bands) == 0, 0).otherwise(F.floor(total / F.lit(float(len(bands)))))


def masked(dn: Column, mask: Column) -> Column:
    """``dn`` where the mask is 0, else 0."""
    return dn * F.abs(mask - 1)


def blend(a: Column, b: Column, k: Column, full: int = 58) -> Column:
    """``trunc(a (1 - w) + b w)`` for the weight k / full, in integers."""
    return F.floor((a * (full - k) + b * k) / F.lit(float(full))).cast("long")
