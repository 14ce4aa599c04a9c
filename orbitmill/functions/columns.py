"""Scalar expressions of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(line: Column) -> Column:
    """Tokens of a line, split at any white space."""
    return F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")


def clamp_noise(x: Column, noise: float = 1e-6) -> Column:
    """Small negative values become 0."""
    return F.when((x < 0) & (x > -noise), F.lit(0.0)).otherwise(x)


def squared_difference(a: Column, b: Column) -> Column:
    return (a - b) * (a - b)


def absolute_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def unit_hash(seed: int, *of: Column) -> Column:
    """A number in [0, 1) from a hash, whatever the partitioning."""
    return (F.shiftrightunsigned(F.xxhash64(*of, F.lit(seed)), 11)).cast("double") / F.lit(float(1 << 53))


def fixed_decimals(x: Column, digits: int) -> Column:
    """A number as text with so many decimals."""
    return F.format_string(f"%.{digits}f", x)
