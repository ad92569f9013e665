"""Snapshot diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(column: str, ints: tuple[str, ...], floats: tuple[str, ...]) -> Column:
    """Comparable text of a field: whole number, two places or trimmed text."""
    c = F.col(column)
    if column in ints:
        return F.bround(c.cast("double")).cast("long").cast("string")
    if column in floats:
        return F.bround(c.cast("double"), 2).cast("decimal(28,2)").cast("string")
    return F.trim(c.cast("string"))


def deleted_ids(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Ids of the old snapshot that the new one lacks."""
    return old.select(key).distinct().join(new.select(key), key, "left_anti")


def modified_fields(old: DataFrame, new: DataFrame, key: str, ints: tuple[str, ...] = (),
                    floats: tuple[str, ...] = ()) -> DataFrame:
    """One row per changed field of the ids in both; null equals null, added ids are ignored."""
    fields = [c for c in old.columns if c != key]
    o = old.select(key, *[canonical(c, ints, floats).alias(f"o_{c}") for c in fields])
    n = new.select(key, *[canonical(c, ints, floats).alias(f"n_{c}") for c in fields])
    cells = F.filter(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"o_{c}").alias("old_value"),
                                        F.col(f"n_{c}").alias("new_value")) for c in fields]),
                     lambda s: ~s["old_value"].eqNullSafe(s["new_value"]))
    return o.join(n, key).select(key, F.inline(cells))
