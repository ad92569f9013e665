"""Evidence step sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.lists import contains_any
from ..functions.sequence import running_sum


def is_critical(action: Column, text: Column) -> Column:
    return contains_any(F.lower(action), X.CRITICAL_ACTIONS) | contains_any(F.lower(text), X.CRITICAL_TEXT)


def _is_pick(rank: Column, n: Column, slots: Column) -> Column:
    """Rank ``r`` (0-based) is some ``(slot + 1) * n div (slots + 1)`` with 0 <= slot < slots.

    The smallest slot + 1 whose pick is at least ``r`` is ``ceil(r * (slots + 1) / n)``.
    """
    s = F.greatest(F.ceil(rank * (slots + 1) / n), F.lit(1))
    return (s <= slots) & (F.floor(s * n / (slots + 1)) == rank)


def select_steps(steps: DataFrame, keys: list[str], budget: int = X.EVIDENCE_STEPS,
                 head: int = X.EVIDENCE_HEAD, tail: int = X.EVIDENCE_TAIL) -> DataFrame:
    """Head, tail and critical steps, the rest of the budget spread evenly.

    ``steps``: keys, step (1-based, dense), action, code. Positions are arithmetic on
    running counts, so no attempt is collected.
    """
    total = steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = steps.join(total, keys).withColumn("_end", (F.col("step") <= head) | (F.col("step") > F.col("_n") - tail))
    d = d.withColumn("_crit", is_critical(F.col("action"), F.col("code")) & ~F.col("_end"))
    d = running_sum(d, keys, "step", (~F.col("_end") & ~F.col("_crit")).cast("int"), "_free_rank")
    d = running_sum(d, keys, "step", F.col("_crit").cast("int"), "_crit_rank")
    sums = d.groupBy(*keys).agg(F.count_if("_end").alias("_ends"), F.count_if("_crit").alias("_crits"))
    d = d.join(sums, keys)
    room = F.lit(budget) - F.col("_ends") - F.col("_crits")
    free = F.col("_n") - F.col("_ends") - F.col("_crits")
    crit_room = F.greatest(F.lit(budget) - F.col("_ends"), F.lit(0))
    keep = (
        F.when(F.col("_n") <= budget, True)
        .when(F.col("_end"), True)
        .when(F.col("_crit"), F.when(room >= 0, True).otherwise(
            _is_pick(F.col("_crit_rank") - 1, F.col("_crits"), crit_room)))
        .otherwise((room > 0) & _is_pick(F.col("_free_rank") - 1, free, room))
    )
    return d.filter(keep).select(*steps.columns)
