"""Unit harmonization."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.cleaning import decimal_comma
from ...functions.lists import strip
from ...functions.sequence import first_rows


@dataclass(frozen=True)
class Unit:
    """How one column converts: 'same', 'single' (divide) or 'single-reverse' (multiply)."""

    mode: str
    factor: float
    low: float
    high: float


def is_filled(column: str) -> Column:
    v = strip(F.col(column).cast("string"))
    return F.coalesce((F.length(v) > 0) & (F.lower(v) != "nan"), F.lit(False))


def convert(value: Column, unit: Unit) -> Column:
    """Keep a value in range; else convert it if the result is in range; else keep it."""
    if unit.mode == "same":
        return value
    other = value / unit.factor if unit.mode == "single" else value * unit.factor
    return F.when(value.between(unit.low, unit.high), value).when(other.between(unit.low, unit.high), other).otherwise(value)


def harmonize(df: DataFrame, units: dict[str, Unit]) -> DataFrame:
    """Complete rows only, converted, as text with two places."""
    complete = reduce(lambda a, b: a & b, [is_filled(c) for c in units])
    d = df.filter(complete)
    for c, u in units.items():
        d = d.withColumn(c, F.bround(convert(decimal_comma(F.col(c)), u), 2).cast("decimal(38,2)").cast("string"))
    return d


def latest_complete(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Latest row per case in which every column is filled."""
    complete = reduce(lambda a, b: a & b, [is_filled(c) for c in columns])
    return first_rows(df.filter(complete), keys, [F.desc(order)])


def join_panels(panels: list[DataFrame], on: list[str]) -> DataFrame:
    """Panels side by side, records in all of them."""
    return reduce(lambda a, b: a.join(b, on), panels)
