"""Rounding as IEEE arithmetic does it: ties of the scaled value go to even."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded(value: Column | str, digits: int = 0) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    scale = F.lit(float(10**digits))
    return F.rint(value.cast("double") * scale) / scale
