"""Table clean-up scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lists import strip


def key(text: Column) -> Column:
    """Trimmed upper-case key."""
    return F.upper(strip(F.coalesce(text.cast("string"), F.lit(""))))


def number(text: Column) -> Column:
    """Number with thousands separators; empty means zero."""
    v = strip(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(","), F.lit("")))
    return F.when(F.length(v) == 0, F.lit(0.0)).otherwise(v.try_cast("double"))


def decimal_comma(text: Column) -> Column:
    """Number written with a decimal comma; empty or ``nan`` means null."""
    v = strip(text.cast("string"))
    return F.when((F.length(v) > 0) & (F.lower(v) != "nan"),
                  F.replace(v, F.lit(","), F.lit(".")).try_cast("double"))


def date_of(text: Column, formats=("yyyy-MM-dd", "MM/dd/yyyy")) -> Column:
    """First date format that parses."""
    v = strip(text.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(f)).cast("date") for f in formats])


def money(value: Column) -> Column:
    """Two places, half to even, with the customary nudge."""
    return F.bround(value + F.lit(1e-9), 2)


def alnum(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")
