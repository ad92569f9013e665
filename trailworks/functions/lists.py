"""Array helpers shared by the text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quote(word: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in word)


def contains_any(text: Column, words) -> Column:
    """True where the text contains at least one of the words: one scan, one pattern."""
    return text.rlike("|".join(_quote(w) for w in words))


def matches_any(text: Column, patterns) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def non_empty(text: Column) -> Column:
    """Empty text becomes null, so that ``coalesce`` can pick the next source."""
    return F.when(F.length(text) > 0, text)


def squeeze(text: Column) -> Column:
    """Collapse every run of white space to one blank."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def strip(text: Column) -> Column:
    """Trim any white space, not just blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fold_case(text: Column) -> Column:
    """Caseless form: lower case, with the sharp s written out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def first_match(rules, default=None) -> Column:
    """Ordered decision list: label of the first condition that holds."""
    expr = None
    for label, condition in rules:
        expr = F.when(condition, F.lit(label)) if expr is None else expr.when(condition, F.lit(label))
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def ordered_distinct(arr: Column) -> Column:
    """Distinct elements in first-seen order."""
    return F.array_distinct(arr)
