"""Pivots, budgets, derived measures, bands, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


AGGREGATES = {"sum": F.sum, "average": F.avg, "count": F.count, "min": F.min, "max": F.max}


def pivot(df: DataFrame, rows: list[str], value: str, how: str, columns: str | None = None,
          labels: list | None = None) -> DataFrame:
    """One axis, or a matrix with given column labels (no extra pass to find them)."""
    agg = AGGREGATES[how](value).alias("value")
    if columns is None:
        return df.groupBy(*rows).agg(agg)
    return df.groupBy(*rows).pivot(columns, labels).agg(agg)


def lookup(df: DataFrame, dimension: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Dimension lookup; first row per key, broadcast while the dimension is small."""
    return df.join(dimension.dropDuplicates(on), on, how)


def budget_long(budget: DataFrame, ids: list[str], periods: list[str], name: str = "fiscal_quarter") -> DataFrame:
    """Wide budget to long; ``Q1_BUDGET`` becomes ``Q1``."""
    return budget.unpivot(ids, periods, name, "budget_amount").withColumn(name, F.replace(name, F.lit("_BUDGET"), F.lit("")))


def budget_variance(expenses: DataFrame, budget: DataFrame, on: list[str], amount: str = "amount") -> DataFrame:
    """Variance and utilization; null without a budget, utilization null for a zero budget."""
    d = expenses.join(budget, on, "left")
    return d.withColumn("variance", F.col(amount) - F.col("budget_amount")).withColumn(
        "utilization_pct", F.try_divide(amount, "budget_amount"))


def margin(quantity: Column, price: Column, cost: Column) -> list[Column]:
    """Revenue, profit and margin."""
    revenue = quantity * price
    profit = revenue - quantity * cost
    return [revenue.alias("revenue"), profit.alias("profit"), F.try_divide(profit, revenue).alias("margin_pct")]


def deviation(value: Column, target: Column) -> Column:
    return F.abs(value - target)


def relative_error(value: Column, target: Column) -> Column:
    return F.try_divide(F.abs(value - target), target)


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("long").cast("string"), F.lit("s"))


def yes_no(condition: Column) -> Column:
    return F.when(condition, "Yes").otherwise("No")


def band(value: Column, limits: list[tuple[str, float]], otherwise: str, inclusive: bool, missing: str | None = None) -> Column:
    """First band whose upper limit is not exceeded (or not reached)."""
    expr = F.when(value.isNull(), F.lit(missing)) if missing is not None else None
    for label, limit in limits:
        hit = value <= limit if inclusive else value < limit
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return expr.otherwise(otherwise)


def experience_band(years: Column) -> Column:
    return band(years, [("Junior", 3), ("Mid", 8), ("Senior", 15)], "Veteran", inclusive=False)


def price_tier(amount: Column) -> Column:
    return band(amount, [("Free", 0), ("Budget", 100), ("Standard", 200)], "Premium", inclusive=True)


def quality_grade(dev: Column) -> Column:
    return band(dev, [("A", 0.5), ("B", 1.0)], "C", inclusive=True, missing="N/A")


def grade_band(score: Column) -> Column:
    return band(-score, [("A", -90), ("B", -80), ("C", -70), ("D", -60)], "F", inclusive=True)


def tagged_union(sources: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Rows of several sources with the name of their source."""
    return reduce(DataFrame.unionByName, [d.withColumn(tag, F.lit(name)) for name, d in sources.items()])
