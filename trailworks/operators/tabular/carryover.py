"""Backlog carry-over as a keyed fold."""

from __future__ import annotations

from array import array
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORK_DAYS = (4, 5, 6)


def plan_days(weeks: DataFrame, keys: list[str], rate: float, quiet_demand: float, overtime_per_day: float,
              rounded: bool) -> DataFrame:
    """Working days per week from the signed carry-over and the demand.

    ``weeks``: keys, week, demand, initial (backlog total including the first week). A plan has
    one row per week after the sum below, so a list is as long as the calendar; it is folded in one pass.
    """
    r = (lambda c: F.bround(c, 2)) if rounded else (lambda c: c)
    d = weeks.groupBy(*keys, "week").agg(F.sum("demand").alias("demand"), F.max("initial").alias("initial"))
    d = d.withColumn("demand", r(F.col("demand")))
    items = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("week", "demand"))).alias("w"), F.max("initial").alias("initial"))
    made = _fold(rate, quiet_demand, overtime_per_day, rounded)
    first = r(F.col("initial") - F.get("w", 0)["demand"]).cast("double")
    d = items.select(*keys, "w", made(F.transform("w", lambda x: x["demand"].cast("double")), first).alias("s"))
    row = F.transform(F.arrays_zip("w", "s.days", "s.capacity", "s.start", "s.end"), lambda x: F.struct(
        x["w"]["week"].alias("week"), x["days"].alias("days"), x["w"]["demand"].cast("double").alias("demand"), x["capacity"].alias("capacity"),
        r(F.greatest(F.lit(0.0), x["start"])).alias("start_queue"), x["end"].alias("end_queue"),
        r(overtime_per_day * F.greatest(F.lit(0), x["days"] - WORK_DAYS[0])).cast("double").alias("overtime")))
    return d.select(*keys, F.inline(row))


def _fold(rate: float, quiet_demand: float, overtime_per_day: float, rounded: bool):
    """The queue of one plan, week after week: a list per plan in, lists of the same length out.

    A batch holds thousands of plans, so results are kept as plain numbers, 28 bytes a week, not as objects.
    """
    low, mid, high = WORK_DAYS

    def r(x: float) -> float:
        return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_EVEN)) if rounded else x

    def plan(demands, start: float) -> list[np.ndarray]:
        out = array("i"), array("d"), array("d"), array("d")
        for demand in demands:
            if start > 0.01:
                days = mid if start + demand - rate * mid <= 0.0 else high
            else:
                days = low if demand <= quiet_demand else mid
            capacity = r(rate * days)
            end = r(start + demand - capacity)
            for column, x in zip(out, (days, capacity, start, end), strict=True):
                column.append(x)
            start = end
        return [np.array(column) for column in out]

    names = ("days", "capacity", "start", "end")

    @F.pandas_udf("days array<int>, capacity array<double>, start array<double>, end array<double>")
    def fold(demands: pd.Series, start: pd.Series) -> pd.DataFrame:
        made = [plan(d.tolist(), s) for d, s in zip(demands, start)]
        return pd.DataFrame({name: pd.Series([m[k] for m in made], dtype=object) for k, name in enumerate(names)})

    return fold
