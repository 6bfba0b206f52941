"""Column form of the bounded options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounded_int(raw: Column, default: int, lowest: int, highest: int) -> Column:
    digits = F.when(F.trim(raw).rlike("^[+-]?[0-9]+$"), F.trim(raw))
    value = digits.try_cast("bigint")
    return F.when(value.between(lowest, highest), value).otherwise(F.lit(default)).cast("bigint")


def bounded_float(raw: Column, default: float, lowest: float, highest: float) -> Column:
    value = F.trim(raw).try_cast("double")
    inside = value.between(lowest, highest) & ~F.isnan(value)
    return F.when(inside, value).otherwise(F.lit(float(default)))
