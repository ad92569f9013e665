"""Row rule audits.

A rule is ``(label, condition)``. Rules become 0/1 columns; nothing is evaluated per row in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.cleaning import key
from ...functions.sequence import first_rows

Rule = tuple[str, Column]


def price_window_rules(register: str, promo: str, sale: str, start: str, end: str) -> list[Rule]:
    day = lambda c: F.to_date(c)
    return [("Price Error", ~F.col(register).eqNullSafe(F.col(promo))),
            ("Window Error", (day(sale) < day(start)) | (day(sale) > day(end)))]


def receiving_rules(received: str, expected: str, storage: str, temp: str) -> list[Rule]:
    return [("Qty Variance", ~F.col(received).eqNullSafe(F.col(expected))),
            ("Cold Chain Error", key(F.col(storage)).isin("CHILLED", "FROZEN") & (key(F.col(temp)) != "OK"))]


def timesheet_rules(breaks: str, hours: str, approval: str) -> list[Rule]:
    """Limits ``min_break`` and ``overtime_threshold`` come from the joined rule table."""
    return [("Break Deficit", F.col(breaks) < F.col("min_break")),
            ("Approval Missing", (F.col(hours) > F.col("overtime_threshold"))
             & (F.length(F.trim(F.coalesce(approval, F.lit("")))) == 0))]


def service_queue_rules(age: str, code: str) -> list[Rule]:
    """Limits ``max_hours`` and ``escalation_required`` come from the joined rule table."""
    return [("SLA Breach", F.col(age) > F.col("max_hours")),
            ("Missing Escalation", F.col("escalation_required") & (F.length(F.trim(F.coalesce(code, F.lit("")))) == 0))]


def detention_rules(actual: str, allowed: str, required: str, status: str) -> list[Rule]:
    return [("Detention Overrun", F.col(actual) > F.col(allowed)),
            ("Seal Error", (key(F.col(required)) == "YES") & (key(F.col(status)) != "VERIFIED"))]


def count_variance_rules(approval: str, expected: str, allowed: str) -> list[Rule]:
    """Against the latest qualifying event, joined as struct ``event``."""
    missing = F.col("event").isNull()
    return [("Missing Final Count", missing),
            ("Approval Gap", ~missing & (key(F.col(approval)) == "YES")
             & (F.abs(F.col(expected) - F.col("event.value")) > F.col(allowed)))]


def zone_rules(planned: str) -> list[Rule]:
    missing = F.col("event").isNull()
    return [("Missing Load Scan", missing),
            ("Zone Mismatch", ~missing & ~F.col("event.value").cast("string").eqNullSafe(F.col(planned).cast("string")))]


def disposition_rules(planned: str) -> list[Rule]:
    missing = F.col("event").isNull()
    return [("Missing Final Event", missing),
            ("Disposition Mismatch", ~missing & ~F.col("event.value").eqNullSafe(key(F.col(planned))))]


def with_rule_table(rows: DataFrame, rules: DataFrame, on: list[str]) -> DataFrame:
    """Limits per tier or role; the rule table is broadcast while it is small."""
    return rows.join(rules, on)


def apply_rules(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """One 0/1 column per rule, their total and a joined summary text."""
    d = rows
    names = []
    for i, (_, condition) in enumerate(rules, start=1):
        names.append(f"error_{i}")
        d = d.withColumn(names[-1], F.coalesce(condition, F.lit(False)).cast("int"))
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    labels = F.filter(F.array(*[F.when(F.col(n) == 1, F.lit(label)) for n, (label, _) in zip(names, rules)]),
                      lambda x: x.isNotNull())
    return d.withColumn("total_errors", total).withColumn(
        "error_summary", F.when(F.col("total_errors") == 0, "None").otherwise(F.array_join(labels, ", ")))


def latest_event(events: DataFrame, keys: list[str], qualifies: Column, value: Column, order: str) -> DataFrame:
    """Latest qualifying event per key; max_by aggregates partially, so hot keys stay cheap."""
    return events.filter(qualifies).groupBy(*keys).agg(
        F.max_by(F.struct(F.col(order).alias("at"), value.alias("value")), order).alias("event"))


def alias_values(events: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Normalize event values through an alias table (alias, name)."""
    a = aliases.select(key(F.col("alias")).alias("_alias"), key(F.col("name")).alias("_name"))
    d = events.withColumn("_alias", key(F.col(column))).join(a, "_alias", "left")
    return d.withColumn(column, F.coalesce("_name", "_alias")).drop("_alias", "_name")


def plan_audit(plan: DataFrame, latest: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """Plan rows against their latest event."""
    return apply_rules(plan.join(latest, keys, "left"), rules)


def summary(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """Groups with errors and a grand total that includes clean groups, in one pass."""
    cols = [F.col(k) for k in keys]
    d = flagged.groupingSets([cols, []], *cols).agg(
        F.grouping(keys[0]).alias("_total"), F.sum("error_1").alias("error_1"), F.sum("error_2").alias("error_2"),
        F.sum("total_errors").alias("total_errors"))
    total = F.col("_total") == 1
    first, *rest = keys
    return d.filter(total | (F.col("total_errors") > 0)).select(
        F.when(total, "Grand Total").otherwise(F.col(first).cast("string")).alias(first),
        *[F.when(total, "-").otherwise(F.col(k).cast("string")).alias(k) for k in rest],
        "error_1", "error_2", "total_errors")


def hot_spots(flagged: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """Groups with the most errors, ties by key."""
    return flagged.groupBy(*keys).agg(F.sum("total_errors").alias("total_errors")).filter("total_errors > 0").orderBy(
        F.desc("total_errors"), *keys).limit(n)


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return first_rows(rows, keys, order)
