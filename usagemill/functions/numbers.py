"""Rounding, clamping and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Nearest, with halves towards plus infinity (-2.5 gives -2)."""
    scale = 10.0**digits
    return F.floor(x * scale + F.lit(0.5)) / scale if digits else F.floor(x + F.lit(0.5))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def with_separators(x: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(x.cast("long"), 0)


def currency(x: Column, digits: int = 2) -> Column:
    """Dollars; halves go up."""
    return F.concat(F.lit("$"), F.format_string(f"%.{digits}f", half_up(F.coalesce(x, F.lit(0.0)), digits).cast("double")))


def percent_off(stated: Column, computed: Column) -> Column:
    """How far computed is from stated, in per cent of stated; 0 unless stated is positive."""
    return F.when(stated > 0, F.abs(stated - computed) / stated * 100).otherwise(F.lit(0.0))
