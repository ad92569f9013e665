"""Two-way lookup and weighted risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.sequence import join_same, ordered_numbers


def scenario_lookup(requests: DataFrame, table: DataFrame, label: str, scenarios: list[str]) -> DataFrame:
    """Value by (row label, scenario header), 0 where absent. ``requests``: label, scenario."""
    long = table.unpivot([label], scenarios, "scenario", "value")
    return requests.join(long, [label, "scenario"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def ratio(top: Column, middle: Column, base: Column) -> Column:
    """``(top - middle) / base * 100``, 0 for a zero base."""
    return F.coalesce(F.try_divide(top - middle, base) * 100, F.lit(0.0))


def risk_statistics(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Spread, linear quartiles and weighted mean per group.

    Quartiles are exact and come from row numbers along ranges of (keys, value), so a group that holds
    most of the rows is spread over many tasks and no task keeps its values in a buffer.
    """
    w = F.sum(weight)
    plain = df.groupBy(*keys).agg(
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"), F.count(value).alias("_n"),
        F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), w), F.lit(0.0)).alias("weighted_mean"))
    names = {"p25": 0.25, "median_value": 0.5, "p75": 0.75}
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value"))
    placed = join_same(ordered_numbers(known, keys, ["_value"], "_place"), plain.select(*keys, "_n"), keys)
    spot = lambda q: F.lit(q) * (F.col("_n") - 1)
    near = [(F.col("_place") == F.floor(spot(q)) + 1) | (F.col("_place") == F.ceil(spot(q)) + 1) for q in names.values()]
    picked = placed.filter(near[0] | near[1] | near[2])

    def quartile(q: float) -> Column:
        low = F.max(F.when(F.col("_place") == F.floor(spot(q)) + 1, F.col("_value")))
        high = F.max(F.when(F.col("_place") == F.ceil(spot(q)) + 1, F.col("_value")))
        share = F.max(spot(q) - F.floor(spot(q)))
        return low + (high - low) * share

    parts = picked.groupBy(*keys).agg(*[quartile(q).alias(n) for n, q in names.items()])
    return join_same(plain, parts, keys, "left").select(
        *keys, "min_value", "max_value", "median_value", "mean_value", "p25", "p75", "weighted_mean")
