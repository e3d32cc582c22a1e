"""Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def volume(length: Column | str, width: Column | str) -> Column:
    """Volume of a spherocylinder: a cylinder with two half-sphere caps."""
    length, width = col(length), col(width)
    radius = width / 2
    return (length - width) * math.pi * radius * radius + F.lit(4 / 3 * math.pi) * radius * radius * radius


def volume_alt(length: Column | str, width: Column | str) -> Column:
    """The same volume in its expanded form, as used on pixel units."""
    length, width = col(length), col(width)
    return width * width * length * (math.pi / 4) - width * width * width * (math.pi / 12)


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def regr_parts(x: Column | str, y: Column | str, prefix: str = "") -> list[Column]:
    """Aggregates of a straight-line fit of y on x (pairs with a null are skipped)."""
    x, y = col(x), col(y)
    return [F.regr_slope(y, x).alias(f"{prefix}slope"), F.regr_intercept(y, x).alias(f"{prefix}intercept"),
            F.regr_r2(y, x).alias(f"{prefix}r2"), F.regr_count(y, x).alias(f"{prefix}n")]


def population_axes(var_y: Column, var_x: Column, cov: Column) -> tuple[Column, Column]:
    """Major and minor axis lengths of the ellipse with the given second moments."""
    mean = (var_y + var_x) / 2
    spread = F.sqrt((var_y - var_x) * (var_y - var_x) / 4 + cov * cov)
    return 4 * F.sqrt(mean + spread), 4 * F.sqrt(F.greatest(mean - spread, F.lit(0.0)))
