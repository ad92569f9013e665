"""Scenario margins and compensation components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.cleaning import money

# Loyalty tiers (minimum years of service, yearly bonus) and per diem terms.
LOYALTY_TIERS = ((20, "Diamond", 25000.0), (16, "Platinum", 16000.0), (11, "Gold", 10000.0), (6, "Silver", 6000.0), (3, "Bronze", 2500.0))
PER_DIEM_RATE, PER_DIEM_DAYS, MIN_ATTENDANCE = 75.0, 200, 0.85


def _with_parameters(df: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """Each row once per parameter set; the sets are literals of the plan, not a second table."""
    sets = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    return df.select("*", F.inline(sets))


def open_campaigns(campaigns: DataFrame, holds: DataFrame, flag: str = "review") -> DataFrame:
    """Campaigns under review that are not on hold."""
    held = holds.filter(F.col("suspension_status") == "hold").select("campaign_id")
    return campaigns.filter(F.col("analysis_flag") == flag).join(held, "campaign_id", "left_anti")


def latest_payments(billing: DataFrame, labels: DataFrame) -> DataFrame:
    """Latest active payment per campaign, labels matched caselessly. ``labels``: label, campaign_id."""
    names = labels.select(F.lower("label").alias("_l"), "campaign_id").distinct()
    return billing.filter(F.col("status") == "active").withColumn("_l", F.lower("campaign_label")).join(
        names, "_l").groupBy("campaign_id").agg(F.max_by("payment", "cycle_tag").alias("payment"))


def clinic_overrides(overrides: DataFrame) -> DataFrame:
    """Highest approved and complete revision."""
    ok = (F.col("state") == "approved") & F.col("revision").isNotNull() & F.col("active_clinics").isNotNull()
    return overrides.filter(ok).groupBy("campaign_id").agg(F.max_by("active_clinics", "revision").alias("override_clinics"))


def margins(campaigns: DataFrame, scenarios: list[tuple[str, int, int]]) -> DataFrame:
    """Yearly cost, revenue and margin per campaign and scenario.

    ``campaigns``: campaign_id, clinics, payment, unit_cost, doses_per_day, crate_cost.
    ``scenarios``: (name, days, dispatches), a handful of cadences.
    """
    d = _with_parameters(campaigns, scenarios, ["scenario", "days", "dispatches"])
    size = F.col("clinics") * F.col("dispatches")
    drug = F.col("unit_cost") * F.col("doses_per_day") * F.col("days") * size / 1000.0
    crate, revenue = F.col("crate_cost") * size, F.col("payment") * size
    return d.select("campaign_id", "scenario", drug.alias("drug_cost"), crate.alias("crate_cost"),
                    revenue.alias("revenue"), (revenue - drug - crate).alias("margin"))


def margin_decision(rows: DataFrame, base: str, other: str, threshold: float) -> DataFrame:
    """Total difference between two scenarios and the decision it leads to."""
    pick = lambda s: F.sum(F.when(F.col("scenario") == s, F.col("margin")))
    d = rows.agg(pick(base).alias("total_base"), pick(other).alias("total_other"))
    diff = F.col("total_other") - F.col("total_base")
    return d.select(money(F.col("total_base")).alias("total_base"), money(F.col("total_other")).alias("total_other"),
                    money(diff).alias("difference"),
                    F.when(F.abs(diff) < threshold, f"move_to_{other}").otherwise(f"keep_{base}").alias("decision"))


def compensation(roster: DataFrame, years: list[tuple[int, float, float]]) -> DataFrame:
    """Quarterly components per employee and year.

    ``roster``: emp_id, base_salary, block_hours, hotel, uniform, attendance, years_of_service.
    ``years``: (year from 0, raise, flight pay rate) of the model years. Tenure grows with the year.
    """
    d = _with_parameters(roster, years, ["year", "raise", "fpp_rate"])
    tenure = F.col("years_of_service") + F.col("year")
    bonus = F.lit(0.0)
    for least, _, amount in reversed(LOYALTY_TIERS):
        bonus = F.when(tenure >= least, amount).otherwise(bonus)
    quarter = lambda c: c / 4
    d = d.select(
        "emp_id", "year", quarter(F.col("base_salary") * F.col("raise")).alias("base_salary"),
        quarter(F.col("block_hours") * F.col("fpp_rate")).alias("flight_pay"),
        F.when(F.col("attendance") >= MIN_ATTENDANCE, quarter(F.lit(PER_DIEM_RATE * PER_DIEM_DAYS))).otherwise(0.0).alias("per_diem"),
        quarter(F.col("hotel")).alias("hotel"), quarter(F.col("uniform")).alias("uniform"), quarter(bonus).alias("loyalty"))
    parts = ["base_salary", "flight_pay", "per_diem", "hotel", "uniform", "loyalty"]
    return d.withColumn("total", sum((F.col(c) for c in parts[1:]), F.col(parts[0])))


def compensation_totals(rows: DataFrame) -> DataFrame:
    """Component totals per year with growth; the window holds one row per model year."""
    parts = ["base_salary", "flight_pay", "per_diem", "hotel", "uniform", "loyalty", "total"]
    w = Window.orderBy("year")
    prev = F.lag("total").over(w)
    return rows.groupBy("year").agg(*[F.sum(c).alias(c) for c in parts]).withColumn(
        "growth", F.try_divide(F.col("total") - prev, prev))
