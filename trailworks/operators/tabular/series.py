"""Series assembly and detrended correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.cleaning import alnum
from ...functions.sequence import first_rows

LAMBDA = 100.0
MIN_YEARS = 8


def annual_series(rows: DataFrame, keys: list[str], period: str, value: str, current_year: int,
                  start_year: int | None = None) -> DataFrame:
    """One value per year; the current year is the mean of its partial periods.

    ``rows``: keys, year, period, value (already filtered by status and version).
    """
    v = F.col(value).try_cast("double")
    d = rows.filter(v.isNotNull()).withColumn("_v", v)
    if start_year is not None:
        d = d.filter(F.col("year") >= start_year)
    past = d.filter(F.col("year") < current_year).groupBy(*keys, "year").agg(F.max_by("_v", period).alias("value"))
    now = d.filter(F.col("year") == current_year).groupBy(*keys, "year").agg(F.avg("_v").alias("value"))
    return past.unionByName(now)


def wide_years(df: DataFrame, ids: list[str], year_columns: dict[str, int]) -> DataFrame:
    """Year columns to rows, numbers only."""
    long = df.unpivot(ids, list(year_columns), "_c", "value")
    years = F.create_map(*[F.lit(x) for kv in year_columns.items() for x in kv])
    return long.select(*ids, years[F.col("_c")].alias("year"), F.col("value").try_cast("double").alias("value")).filter(
        F.col("value").isNotNull())


def by_priority(rows: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """Accepted aliases only, official records, best priority per period.

    ``rows``: alias, record_type, keys, priority, amount. ``aliases``: series, alias.
    """
    a = aliases.select("series", alnum(F.col("alias")).alias("_a")).distinct()
    d = rows.filter(F.lower("record_type") == "official").withColumn("_a", alnum(F.col("alias"))).join(a, "_a")
    d = d.withColumn("priority", F.col("priority").try_cast("double")).withColumn("amount", F.col("amount").try_cast("double"))
    return d.filter(F.col("priority").isNotNull() & F.col("amount").isNotNull()).groupBy("series", *keys).agg(
        F.min_by("amount", "priority").alias("amount"))


def from_register(history: DataFrame, updates: DataFrame, register: DataFrame, current_year: int) -> DataFrame:
    """Source code, status and version named by a register.

    ``register``: series, history_code, history_status, current_code, version. ``history``:
    code, status, year, value. ``updates``: code, version, year, value.
    """
    r = register
    past = history.join(r, (F.col("code") == F.col("history_code"))
                        & (F.lower("status") == F.lower("history_status"))).filter(F.col("year") < current_year).select(
        "series", "year", F.col("value").try_cast("double").alias("value")).filter("value is not null")
    now = updates.join(r.select("series", "current_code", F.col("version").alias("_v")),
                       (F.col("code") == F.col("current_code")) & (F.col("version") == F.col("_v"))) \
        .filter(F.col("year") == current_year).groupBy("series", "year").agg(F.avg(F.col("value").try_cast("double")).alias("value"))
    return first_rows(past, ["series", "year"], ["value"]).unionByName(now)


def real_log(nominal: Column, deflator: Column) -> Column:
    return F.ln(nominal / deflator)


def hp_cycle(values: np.ndarray, lam: float = LAMBDA) -> np.ndarray:
    """Deviation from the smooth trend that solves ``(I + lam D'D) trend = values``, D the second differences.

    The matrix has two bands on each side of the diagonal, so it is split into a unit lower band, a
    diagonal and its transpose in one pass over the series, and solved in another one backwards.
    """
    n = len(values)
    if n < 3:
        return np.zeros(n)
    main, near, far = np.ones(n), np.zeros(n), np.zeros(n)
    for k in range(n - 2):          # one second difference touches three neighbours
        main[k:k + 3] += lam * np.array([1.0, 4.0, 1.0])
        near[k:k + 2] -= 2.0 * lam
        far[k] += lam
    pivot, one, two, part = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        a = (pivot[k - 1], one[k - 1], two[k - 1], part[k - 1]) if k > 0 else (0.0,) * 4
        b = (pivot[k - 2], two[k - 2], part[k - 2]) if k > 1 else (0.0,) * 3
        pivot[k] = main[k] - a[0] * a[1] ** 2 - b[0] * b[1] ** 2
        one[k] = (near[k] - a[0] * a[1] * a[2]) / pivot[k]
        two[k] = far[k] / pivot[k]
        part[k] = values[k] - a[1] * a[3] - b[1] * b[2]
    trend = part / pivot
    for k in range(n - 2, -1, -1):
        trend[k] -= one[k] * trend[k + 1] + (two[k] * trend[k + 2] if k + 2 < n else 0.0)
    return values - trend


def cycle_correlation(aligned: DataFrame, keys: list[str], lam: float = LAMBDA, min_years: int = MIN_YEARS) -> DataFrame:
    """Correlation of the cycles of two real log series per group.

    ``aligned``: keys, year, a, b - one row per year, so a group is as long as the calendar.
    """
    names = ", ".join(f"{k} {aligned.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("year")
        first = {k: pdf[k].iloc[0] for k in keys}
        corr = None
        if len(pdf) >= min_years:
            a, b = hp_cycle(pdf["a"].to_numpy(), lam), hp_cycle(pdf["b"].to_numpy(), lam)
            if a.std() > 0 and b.std() > 0:
                corr = float(np.corrcoef(a, b)[0, 1])
        return pd.DataFrame([{**first, "n_years": len(pdf), "correlation": corr}])

    return aligned.groupBy(*keys).applyInPandas(run, f"{names}, n_years long, correlation double")
