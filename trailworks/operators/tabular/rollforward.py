"""Roll-forward schedules. Money is DECIMAL(18,2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def latest_records(records: DataFrame, keys: list[str], revision: str, active, pos: str) -> DataFrame:
    """Highest active revision per key; equal revisions keep the first row."""
    cols = [c for c in records.columns if c not in keys]
    return records.filter(active).groupBy(*keys).agg(
        F.max_by(F.struct(*cols), F.struct(F.col(revision), -F.col(pos))).alias("r")).select(*keys, "r.*")


def dense_months(openings: DataFrame, flows: DataFrame, keys: list[str], months: DataFrame) -> DataFrame:
    """Every calendar month per contract, zero where nothing happened.

    ``openings``: keys, opening. ``flows``: keys, month, adds, releases (summed per month here).
    ``months`` is the reporting calendar.
    """
    f = flows.groupBy(*keys, "month").agg(F.sum(F.col("adds").cast(MONEY)).cast(MONEY).alias("adds"),
                                          F.sum(F.col("releases").cast(MONEY)).cast(MONEY).alias("releases"))
    names = months.agg(F.array_sort(F.collect_set("month")).alias("_months"))   # a reporting calendar
    grid = openings.join(F.broadcast(names)).select(*keys, F.col("opening").cast(MONEY).alias("opening"), F.explode("_months").alias("month"))
    zero = F.lit(0).cast(MONEY)
    return grid.join(f, [*keys, "month"], "left").select(
        *keys, "opening", "month", F.coalesce("adds", zero).alias("adds"), F.coalesce("releases", zero).alias("releases"))


def roll_forward(rows: DataFrame, keys: list[str], month: str = "month") -> DataFrame:
    """Running balance = opening + adds - releases. One row per contract and month."""
    w = Window.partitionBy(*keys).orderBy(month).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("ending_balance", (F.col("opening").cast(MONEY) + F.sum(
        F.col("adds").cast(MONEY) - F.col("releases").cast(MONEY)).over(w)).cast(MONEY))


def apply_patches(base: DataFrame, patches: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``override`` replaces by filled fields, ``insert`` adds a row; one patch per key and action."""
    filled = lambda c: F.when(F.length(F.col(f"p.{c}").cast("string")) > 0, F.col(f"p.{c}"))
    over = patches.filter(F.col("action") == "override").select(*key, F.struct(*columns).alias("p"))
    types = {c: base.schema[c].dataType for c in columns}
    patched = base.join(over, key, "left").select(
        *[c for c in base.columns if c not in columns],
        *[F.coalesce(filled(c).cast(types[c]), F.col(c)).alias(c) for c in columns])
    extra = patches.filter(F.col("action") == "insert").select(*key, *[F.col(c).cast(types[c]).alias(c) for c in columns])
    return patched.unionByName(extra, allowMissingColumns=True)


def totals(rolled: DataFrame, account: str, gl: DataFrame) -> DataFrame:
    """Additions, releases, ending balance and ledger difference per account and overall.

    ``rolled``: account, month, opening, adds, releases, ending_balance. ``gl``: account, gl_balance.
    """
    monthly = rolled.groupBy(account, "month").agg(*[F.sum(c).alias(c) for c in ("adds", "releases", "ending_balance")])
    d = monthly.groupBy(account).agg(F.sum("adds").alias("adds"), F.sum("releases").alias("releases"), F.max("month").alias("_month"),
                                     F.max_by("ending_balance", "month").alias("ending_balance"))
    # one row per account from here on; the balance counts only where the account has the last month of all
    last = F.max("_month").over(Window.partitionBy())
    d = d.withColumn("ending_balance", F.when(F.col("_month") == last, F.col("ending_balance"))).drop("_month")
    d = d.join(gl, account, "left").withColumn("difference", F.col("gl_balance") - F.col("ending_balance"))
    return d.rollup(account).agg(*[F.sum(c).alias(c) for c in ("adds", "releases", "ending_balance", "gl_balance", "difference")]) \
        .withColumn(account, F.coalesce(F.col(account).cast("string"), F.lit("Total")))
