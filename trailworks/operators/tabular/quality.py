"""Process control statistics. All sums are closed forms of aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ...functions.sequence import neighbour, numbered

# Control chart constants for ranges of two, 95 % normal quantile.
D2, D4 = 1.128, 3.267
Z95 = 1.959963984540054


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coef in (even, odd):
            d = 1.0 + coef * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + coef / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _f_tail(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def _t_tail(t: float, df: float) -> float:
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def _t_quantile(p: float, df: float) -> float:
    """Two-sided: the t with tail probability ``p``, by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if _t_tail(mid, df) > p else (lo, mid)
    return (lo + hi) / 2.0


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([_f_tail(x, a, b) if pd.notna(x) and a > 0 and b > 0 else np.nan for x, a, b in zip(f, d1, d2)])


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([_t_tail(x, d) if pd.notna(x) and d > 0 else np.nan for x, d in zip(t, df)])


@F.pandas_udf(DoubleType())
def t_quantile_95(df: pd.Series) -> pd.Series:
    cache: dict[float, float] = {}
    return pd.Series([cache.setdefault(d, _t_quantile(0.05, d)) if pd.notna(d) and d > 0 else np.nan for d in df])


def indexed(df: DataFrame, keys: list[str], order: list[str], chunk: Column, out: str = "idx") -> DataFrame:
    """Position of each observation in its series."""
    return numbered(df, keys, order, out, chunk)


def anova(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """One-way analysis of variance, from per-group counts, means and squared deviations."""
    g = df.groupBy(*keys, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"),
                                     (F.var_pop(value) * F.count(value)).alias("ss")).filter("n > 0")
    total = g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum("ss").alias("within"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")).alias("between"),
        F.min_by(group, F.struct(-F.col("m"), F.col(group))).alias("highest_mean_group"),
        F.min_by(group, F.struct(F.col("m"), F.col(group))).alias("lowest_mean_group"))
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    f = F.try_divide(F.try_divide("between", d1), F.try_divide("within", d2))
    return total.select(*keys, "groups", "n", f.alias("f_stat"), d1.cast("double").alias("df_between"),
                        d2.cast("double").alias("df_within"), "highest_mean_group", "lowest_mean_group").withColumn(
        "p_value", f_p_value("f_stat", "df_between", "df_within"))


def control_limits(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Individuals and moving range limits."""
    d = neighbour(df, keys, index, F.col(value), "_prev")
    s = d.groupBy(*keys).agg(F.avg(value).alias("center"), F.avg(F.abs(F.col(value) - F.col("_prev"))).alias("mr_bar"))
    sigma = F.col("mr_bar") / D2
    return s.select(*keys, "center", "mr_bar", (F.col("center") + 3 * sigma).alias("ucl"),
                    (F.col("center") - 3 * sigma).alias("lcl"), (D4 * F.col("mr_bar")).alias("mr_ucl"))


def regression(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Trend on the index with its t statistic and direction."""
    y, x = F.col(value), F.col(index).cast("double")
    d = df.groupBy(*keys).agg(F.count(value).alias("n"), F.regr_slope(y, x).alias("slope"),
                              F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"),
                              F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    sse = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    se = F.sqrt(sse / F.nullif(F.col("n") - 2, F.lit(0)) / F.nullif(F.col("sxx"), F.lit(0.0)))
    t = F.when((F.col("n") <= 2) | (F.col("sxx") == 0), 0.0).otherwise(F.coalesce(F.try_divide("slope", se), F.lit(0.0)))
    slope = F.coalesce("slope", F.lit(0.0))
    return d.select(*keys, "n", slope.alias("slope"), "intercept", "r", t.alias("t_stat"),
                    F.when(F.abs(t) < 2.0, "Stable").otherwise("Unstable").alias("stability"),
                    F.when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("flat").alias("direction"))


def one_sample_t(df: DataFrame, keys: list[str], value: str, target: float) -> DataFrame:
    """Test of the mean against a target, interval and lower capability."""
    d = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    se = F.col("std") / F.sqrt("n")
    d = d.withColumn("df", (F.col("n") - 1).cast("double")).withColumn("t_stat", F.try_divide(F.col("mean") - target, se))
    d = d.withColumn("p_value", t_p_value("t_stat", "df")).withColumn("_half", t_quantile_95("df") * se)
    return d.select(*keys, "n", "mean", "std", "t_stat", "p_value", (F.col("mean") - F.col("_half")).alias("ci_low"),
                    (F.col("mean") + F.col("_half")).alias("ci_high"),
                    F.when(F.col("p_value") < 0.05, "reject_h0").otherwise("fail_to_reject_h0").alias("decision"),
                    F.try_divide(F.col("mean") - target, 3 * F.col("std")).alias("cpk_lower"))


def variation(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Coefficient of variation per series."""
    m = F.avg(value)
    return df.groupBy(*keys).agg(m.alias("mean"), F.stddev_samp(value).alias("std"),
                                 F.when(m == 0, float("inf")).otherwise(F.stddev_samp(value) / m).alias("cv"))


def rank_by_variation(cv: DataFrame, scope: list[str], name: str) -> DataFrame:
    """Most variable process first; a scope holds one row per process."""
    w = Window.partitionBy(*scope).orderBy(F.desc("cv"), name)
    return cv.withColumn("cv_rank", F.row_number().over(w))


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """95 % interval of a share, in percent."""
    p = successes / n
    denom = 1 + z * z / n
    center = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / denom
    return 100 * (center - half), 100 * (center + half)


def failure_rate(df: DataFrame, keys: list[str], failures: str, units: str, target_pct: float = 1.0) -> DataFrame:
    """Overall failure rate, its interval and capability against a target."""
    d = df.groupBy(*keys).agg(F.sum(failures).alias("failures"), F.sum(units).alias("units"))
    low, high = wilson(F.col("failures"), F.col("units"))
    rate = 100 * F.col("failures") / F.col("units")
    return d.select(*keys, "failures", "units", rate.alias("rate_pct"), low.alias("ci_low"), high.alias("ci_high"),
                    F.when(rate <= target_pct, "Capable").otherwise("Not Capable").alias("capability"))
