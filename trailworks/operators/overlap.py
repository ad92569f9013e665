"""Token-overlap joins without all pairs.

A pair that shares at least ``need`` of the ``n`` tokens of the left set must share one
of its ``n - need + 1`` rarest tokens. Joining on those only is exact and skips the most
common tokens, which would otherwise pair nearly everything with everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def rarest_tokens(sets: DataFrame, key: list[str], need: Column, frequency: DataFrame) -> DataFrame:
    """``sets``: key, tokens. ``frequency``: token, df. Returns key, token.

    Tokens that the other side never uses have frequency zero: they can not be the
    shared one, but they do count in the prefix.
    """
    n = F.size("tokens")
    rows = sets.select(*key, n.alias("_n"), need.alias("_need"), F.explode("tokens").alias("token"))
    rows = rows.join(frequency, "token", "left")
    # Token sets are bounded by one text, not by the table.
    w = Window.partitionBy(*key).orderBy(F.coalesce("df", F.lit(0)), "token")
    return (
        rows.withColumn("_r", F.row_number().over(w))
        .filter((F.col("_r") <= F.col("_n") - F.col("_need") + 1) & F.col("df").isNotNull())
        .select(*key, "token")
    )


def candidate_pairs(left: DataFrame, left_key: list[str], need: Column,
                    right_tokens: DataFrame, right_key: list[str]) -> DataFrame:
    """Pairs that may share ``need`` tokens. ``right_tokens``: right_key, token (distinct)."""
    frequency = right_tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    prefix = rarest_tokens(left, left_key, need, frequency)
    return prefix.join(right_tokens, "token").select(*left_key, *right_key).distinct()
