"""Replenishment coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.cleaning import key

EPS = 1e-9


def round4(v: Column) -> Column:
    return F.bround(v * 10000, 0) / 10000


def latest_shipments(feed: DataFrame, ref: str, revision: str, states: tuple[str, ...], pos: str,
                     aliases: DataFrame | None = None, alias: str | None = None) -> DataFrame:
    """Latest revision per reference, then allowed states, then alias to location.

    ``revision`` may be a number or a date; equal revisions keep the first row. The state
    filter comes after the choice: a cancelled latest revision removes the shipment.
    """
    cols = [c for c in feed.columns if c != ref]
    last = feed.groupBy(ref).agg(F.max_by(F.struct(*cols), F.struct(F.col(revision), -F.col(pos))).alias("r")).select(ref, "r.*")
    d = last.filter(key(F.col("state")).isin(*states))
    if aliases is None:
        return d
    a = aliases.select(key(F.col("alias")).alias("_alias"), F.col("location")).filter(F.length("_alias") > 0)
    return d.withColumn("_alias", key(F.col(alias))).join(a, "_alias").drop("_alias")


def coverage(stock: DataFrame, inbound: DataFrame, keys: list[str], as_of: Column, horizon: Column, pack: Column) -> DataFrame:
    """Days on hand, stock-out date, need within the horizon, containers, required date.

    ``stock``: keys, units, rate. ``inbound``: keys, eta, qty.
    """
    inside = F.col("eta") <= horizon
    arrivals = inbound.groupBy(*keys).agg(F.sum(F.when(inside, F.col("qty"))).alias("_in"), F.min(F.when(inside, F.col("eta"))).alias("earliest"))
    d = stock.join(arrivals, keys, "left").withColumn("inbound", F.coalesce("_in", F.lit(0.0)))
    moving = F.col("rate") > 0
    doh = F.when(moving, F.col("units") / F.col("rate"))
    out = F.when(moving, F.date_add(as_of, F.floor(doh).cast("int")))
    remaining = F.col("rate") * F.datediff(horizon, as_of)
    need = F.when(moving, F.greatest(F.lit(0.0), remaining - F.col("units") - F.col("inbound"))).otherwise(0.0)
    packs = F.when(need > 0, F.ceil(need / pack)).otherwise(0).cast("long")
    required = F.when(packs > 0, out)
    return d.select(
        *keys, "units", "rate", round4(doh).alias("days_on_hand"), out.alias("stock_out_date"), "inbound",
        round4(F.when(moving, (F.col("units") + F.col("inbound")) / F.col("rate"))).alias("delivered_days"),
        round4(remaining).alias("remaining_demand"), round4(need).alias("additional"), packs.alias("containers"),
        required.alias("required_date"),
        F.coalesce((packs > 0) & (F.col("earliest").isNull() | (required < F.col("earliest"))), F.lit(False)).alias("earlier"))


def stock_plan(stock: DataFrame, inbound: DataFrame, keys: list[str], as_of: Column, horizon: Column, pack: Column,
               variant: str = "plain", z: float = 1.645) -> DataFrame:
    """Variant with safety stock or expiring stock, and rounding with a small tolerance.

    The earliest arrival is not limited to the horizon here; if it comes before the
    stock-out, the required date follows from stock and inbound together.
    """
    arrivals = inbound.groupBy(*keys).agg(F.sum(F.when(F.col("eta") <= horizon, F.col("qty"))).alias("_in"), F.min("eta").alias("earliest"))
    d = stock.join(arrivals, keys, "left").withColumn("inbound", F.coalesce("_in", F.lit(0.0)))
    usable = F.greatest(F.lit(0.0), F.col("units") - F.col("expiring")) if variant == "shelf" else F.col("units")
    days = F.datediff(horizon, as_of)
    safety = z * F.col("stddev") * F.sqrt(F.greatest(F.lit(0), days)) if variant == "stochastic" else F.lit(0.0)
    moving = F.col("rate") > 0
    doh = F.when(moving, usable / F.col("rate"))
    out = F.when(moving, F.date_add(as_of, F.floor(doh + EPS).cast("int")))
    delivered = F.when(moving, (usable + F.col("inbound")) / F.col("rate"))
    need = F.when(moving, F.greatest(F.lit(0.0), F.col("rate") * days + safety - usable - F.col("inbound"))).otherwise(0.0)
    packs = F.when(need > 0, F.ceil((need - EPS) / pack)).otherwise(0).cast("long")
    early = F.coalesce(F.col("earliest") <= out, F.lit(False))
    required = F.when(packs > 0, F.when(early, F.date_add(as_of, F.floor(delivered + EPS).cast("int"))).otherwise(out))
    return d.select(
        *keys, usable.alias("usable"), safety.alias("safety_stock"), doh.alias("days_on_hand"), out.alias("stock_out_date"),
        "inbound", need.alias("additional"), packs.alias("containers"), required.alias("required_date"),
        ((packs > 0) & (F.abs(packs * pack - need) > EPS)).alias("rounding"),
        F.coalesce((packs > 0) & (F.col("earliest").isNull() | (required < F.col("earliest"))), F.lit(False)).alias("earlier"))
