"""Rounding and ratios with the host-language conventions the reports use: half to even, no division by zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, places: int = 0) -> Column:
    """Half-even rounding of a double to a number of decimals."""
    scale = float(10**places)
    return F.rint(c * scale) / scale


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(default).cast("double"))


def clipped(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def sql_rounded(x: str, places: int) -> str:
    """The same rounding as DuckDB SQL."""
    y = f"(({x}) * {float(10**places)})"
    return f"((CASE WHEN {y} - floor({y}) = 0.5 THEN 2 * round({y} / 2) ELSE floor({y} + 0.5) END) / {float(10**places)})"
