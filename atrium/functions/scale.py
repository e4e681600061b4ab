"""Drawing scales as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def metres_per_pixel(scale: Column, dpi: float = 300.0) -> Column:
    """Of a scale like "1:100" at a printing resolution; null for bad texts and for no or a negative second part."""
    parts = F.split(scale, ":")
    n, d = (F.get(parts, i).try_cast("double") for i in (0, 1))
    return F.when((F.size(parts) == 2) & (d > 0) & (n != 0), F.lit(0.0254 / dpi) * (d / n))


def scale_ratio(scale: Column) -> Column:
    """The older rule: "1:100" is 0.01; 1 for a text without a colon."""
    parts = F.split(scale, ":")
    n, d = (F.get(parts, i).try_cast("double") for i in (0, 1))
    return F.when(scale.contains(":"), F.try_divide(n, d)).otherwise(F.lit(1.0))


def to_metres(pixels: Column, factor: Column) -> Column:
    return F.when(factor.isNotNull() & (pixels > 0), pixels * factor)


def to_square_metres(pixels: Column, factor: Column) -> Column:
    return F.when(factor.isNotNull() & (pixels > 0), pixels * (factor * factor))


def scale_in_text(text: Column) -> Column:
    """The scale that a text names ("Scala 1 : 100"), as "1:100"; null without one."""
    n = F.regexp_extract(text, r"(?i)scal[ae]\s*1\s*:\s*(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("1:"), n))


def chosen_scale(given: Column, found: Column, default: str = "1:100") -> Column:
    """The user's scale, else the drawing's, else the default."""
    return F.coalesce(given, found, F.lit(default))
