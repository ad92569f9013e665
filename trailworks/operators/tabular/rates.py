"""Rate instructions and rate matrix updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.cleaning import alnum
from ...functions.lists import contains_any

# Markers and instruction pattern.
IGNORE_MARKERS = ("archive", "archived", "superseded", "draft", "obsolete")
PREFER_MARKERS = ("final", "approved", "live", "current")
UPDATE_PATTERN = r"(?i)([A-Za-z0-9]+)\s+to\s+([A-Za-z0-9]+)\s*=\s*([0-9]+(?:\.[0-9]+)?)"


def instructions(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The instruction in force per document: best score, then the latest. ``chunks``: keys, idx, chunk."""
    low = F.lower("chunk")
    score = F.when(contains_any(low, PREFER_MARKERS), 5).otherwise(0) - F.when(contains_any(low, IGNORE_MARKERS), 5).otherwise(0)
    part = lambda i: F.regexp_extract("chunk", UPDATE_PATTERN, i)
    d = chunks.filter(F.col("chunk").rlike(UPDATE_PATTERN)).select(
        *keys, "idx", score.alias("score"), part(1).alias("from_token"), part(2).alias("to_token"), part(3).cast("double").alias("rate"))
    return d.groupBy(*keys).agg(F.max_by(F.struct("from_token", "to_token", "rate"), F.struct("score", "idx")).alias("u")).select(*keys, "u.*")


def resolve_labels(updates: DataFrame, aliases: DataFrame) -> DataFrame:
    """Note tokens to table labels; unknown tokens stay. ``aliases``: note_token, label."""
    a = aliases.select(alnum(F.col("note_token")).alias("_t"), "label")
    d = updates
    for c in ("from_token", "to_token"):
        d = d.withColumn("_t", alnum(F.col(c))).join(a, "_t", "left").withColumn(c, F.coalesce("label", c)).drop("_t", "label")
    return d


def update_matrix(rates: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Write the direct rate, or the inverse where the direct cell is computed.

    ``rates``: keys, from_token, to_token, rate, is_formula.
    """
    pair = [*keys, "from_token", "to_token"]
    direct = updates.select(*pair, F.col("rate").alias("_direct"))
    swapped = updates.select(*keys, F.col("to_token").alias("from_token"), F.col("from_token").alias("to_token"), (1.0 / F.col("rate")).alias("_inverse"))
    blocked = rates.filter("is_formula").select(*keys, F.col("to_token").alias("from_token"), F.col("from_token").alias("to_token"), F.lit(True).alias("_blocked"))
    d = rates.join(direct, pair, "left").join(swapped, pair, "left").join(blocked, pair, "left")
    writable = ~F.col("is_formula")
    return d.select(*pair, F.when(writable & F.col("_direct").isNotNull(), F.col("_direct"))
                    .when(writable & F.col("_blocked") & F.col("_inverse").isNotNull(), F.col("_inverse"))
                    .otherwise(F.col("rate")).alias("rate"), "is_formula")
