"""Evaluate costly expressions once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row ``inline``.

    A filter on a plain projected column is pushed below it and repeats its expression.
    A generator stops that: long pattern cascades are evaluated once per row, and the
    optimizer does not copy them into every later predicate.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
