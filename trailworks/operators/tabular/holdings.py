"""Holdings snapshots and comparisons.

``holdings``: filing, period, security, issuer, class, value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.sequence import first_rows

# Class titles that count as stock.
STOCK_CLASSES = (
    "com", "common stock", "cl a", "com new", "class a", "stock", "common", "com cl a", "com shs",
    "sponsored adrs", "sponsored adr", "sponsored ads", "adr", "equity", "cmn", "cl b", "ord shs",
    "cl a com", "class a com", "cap stk cl a", "comm stk", "cl b new", "cap stk cl c", "cl a new",
    "foreign stock", "shs cl a",
)


def is_stock(column="class", classes=STOCK_CLASSES):
    return F.lower(column).isin(*classes)


def snapshot_totals(holdings: DataFrame, keys: list[str], classes=STOCK_CLASSES) -> DataFrame:
    """Total value, stock rows and stock value per filing."""
    stock = is_stock(classes=classes)
    return holdings.groupBy(*keys).agg(
        F.sum("value").alias("aum"), F.count_if(stock).alias("stock_holdings"),
        F.coalesce(F.sum(F.when(stock, F.col("value"))), F.lit(0)).alias("stock_aum"),
        F.count_distinct(F.when(stock, F.col("security"))).alias("stock_securities"))


def positions(holdings: DataFrame, keys: list[str], classes=STOCK_CLASSES, order: str | None = None) -> DataFrame:
    """Stock value per security; the name of the first row is kept."""
    name = F.min_by("issuer", order) if order else F.min("issuer")
    return holdings.filter(is_stock(classes=classes)).groupBy(*keys, "security").agg(
        name.alias("issuer"), F.sum("value").alias("value"))


def compare(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Change per security between two periods, zero where absent."""
    on = [*keys, "security"]
    zero = lambda c: F.coalesce(c, F.lit(0).cast(current.schema["value"].dataType))
    c = current.select(*on, F.col("issuer").alias("_ci"), F.col("value").alias("_cv"))
    b = baseline.select(*on, F.col("issuer").alias("_bi"), F.col("value").alias("_bv"))
    return c.join(b, on, "full").select(
        *on, F.coalesce("_ci", "_bi").alias("issuer"), zero("_cv").alias("value_current"),
        zero("_bv").alias("value_baseline"), (zero("_cv") - zero("_bv")).alias("change"))


def top_changes(changes: DataFrame, keys: list[str], n: int, kind: str) -> DataFrame:
    """Top buys, sells or new positions; ties by security."""
    rule = {"buy": F.col("change") > 0, "sell": F.col("change") < 0,
            "new": (F.col("value_baseline") == 0) & (F.col("value_current") > 0)}[kind]
    first = F.asc("change") if kind == "sell" else F.desc("change")
    return first_rows(changes.filter(rule), keys, [first, "security"], n)


def top_holders(holdings: DataFrame, filers: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """Largest holders per security with the manager's name. ``filers``: filing, manager."""
    by = keys or ["security"]
    sums = holdings.groupBy(*by, "filing").agg(F.sum("value").alias("value"))
    top = first_rows(sums, by, [F.desc("value"), "filing"], n)
    return top.join(filers.groupBy("filing").agg(F.min("manager").alias("manager")), "filing", "left")


def class_breakdown(holdings: DataFrame, keys: list[str], n: int, classes=STOCK_CLASSES) -> DataFrame:
    """T5: most frequent class titles."""
    counts = holdings.filter(is_stock(classes=classes)).groupBy(*keys, F.lower("class").alias("class")).agg(
        F.count(F.lit(1)).alias("n"))
    return first_rows(counts, keys, [F.desc("n"), "class"], n)


def dedup_alerts(alerts: DataFrame, types: dict[str, list[str]], order: str) -> DataFrame:
    """Known alert types, first one per composite key of its type."""
    parts = [first_rows(alerts.filter(F.col("type") == t), ["type", *key], [order]) for t, key in types.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def value_grid(holdings: DataFrame, requests: DataFrame) -> DataFrame:
    """Value of each requested (filing, security) cell, zeros kept.

    ``requests`` is the list of wanted cells. Only cells that were asked for exist, so the
    grid grows with the request and not with managers times securities.
    """
    wanted = requests.distinct()
    sums = holdings.join(wanted, ["filing", "security"], "left_semi").groupBy("filing", "security").agg(
        F.sum("value").alias("value"))
    return wanted.join(sums, ["filing", "security"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
