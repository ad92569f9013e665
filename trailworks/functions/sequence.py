"""Ordered computations that stay parallel when one key holds most of the rows.

A plain window puts a whole key into one task. Here the order of a key is cut into
chunks (a column derived from the order column, such as ``step_idx div 4096``). The
window runs inside a chunk, one small row per chunk carries totals or border values,
and a second window over those rows supplies what precedes the chunk. Results are
exact. Key columns must not be null, but for ``ordered_numbers`` and ``chunk_numbers``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

STEP_CHUNK = 4096


def step_chunk(order: str, size: int = STEP_CHUNK) -> Column:
    return F.floor(F.col(order) / size)


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, out: str,
                chunk: Column | None = None, inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` per key in ``order``."""
    data = df.withColumn("_chunk", step_chunk(order) if chunk is None else chunk).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        data.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_total"))
        .withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    return (
        data.withColumn("_run", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .join(base, [*keys, "_chunk"])
        .withColumn(out, F.col("_run") + F.col("_base"))
        .drop("_chunk", "_v", "_run", "_base")
    )


def _preceding(totals: DataFrame, keys: list[str], many: bool) -> DataFrame:
    """(keys, _chunk, _base): the sum of ``_total`` over the earlier chunks of a key.

    With ``many`` the chunk rows themselves are cut into even pieces of their order, and only one row for
    each piece and key goes through a window over the key.
    """
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    if not many:
        return totals.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    # the range partitioning reads its input twice
    ranged = cut_lineage(totals).repartitionByRange(*keys, "_chunk").withColumn("_piece", F.spark_partition_id())
    inside = Window.partitionBy("_piece", *keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    run = cut_lineage(ranged.withColumn("_run", F.coalesce(F.sum("_total").over(inside), F.lit(0))))
    pieces = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = run.groupBy(*keys, "_piece").agg(F.sum("_total").alias("_sum")).withColumn("_earlier", F.coalesce(F.sum("_sum").over(pieces), F.lit(0))).drop("_sum")
    return run.join(sums, [*keys, "_piece"]).select(*keys, "_chunk", (F.col("_run") + F.col("_earlier")).alias("_base"))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, chunk: Column, many: bool = False) -> DataFrame:
    """Row number per key; ``chunk`` must not decrease along ``order``.

    ``many``: a key may have so many chunks that one task should not see a row of each.
    """
    data = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    base = _preceding(data.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_total")), keys, many)
    return (
        data.withColumn("_run", F.row_number().over(inside))
        .join(base, [*keys, "_chunk"])
        .withColumn(out, F.col("_run") + F.col("_base"))
        .drop("_chunk", "_run", "_base")
    )


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the keys come from ``left``."""
    other = {k: f"_other{i}" for i, k in enumerate(keys)}
    both = [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()]
    return left.join(right.withColumnsRenamed(other), both, how).drop(*other.values())


def ordered_numbers(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Row number per key along any order, without a chunk column.

    A range partitioning by key and order gives even pieces whatever the values look like; the piece
    is the chunk. Rows that tie in the order are numbered in any order, as by a window. Null keys are
    keys like others.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_piece", F.spark_partition_id())
    inside = Window.partitionBy("_piece", *keys).orderBy(*order)
    run = cut_lineage(ranged.withColumn("_run", F.row_number().over(inside)))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        run.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_total"))
        .withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    )
    return join_same(run, base, [*keys, "_piece"]).withColumn(out, F.col("_run") + F.col("_base")).drop("_piece", "_run", "_base")


def first_chunk_zero(order: str, size: int = STEP_CHUNK) -> Column:
    """Chunk of an order that starts near 0; what is null or negative comes first and is in chunk 0 too."""
    return F.greatest(F.coalesce(step_chunk(order, size), F.lit(0)), F.lit(0))


def chunk_numbers(df: DataFrame, keys: list[str], order: str, chunk: str, names: dict[str, list[str]]) -> DataFrame:
    """Row numbers along one order, a column for each of ``names`` with the keys it has besides ``keys``.

    ``chunk``: a column made by ``first_chunk_zero``; it is dropped. Rows dealt by keys and chunk are not dealt
    anew. Null keys are keys like others. Chunk 0 has its numbers from the windows, so only keys with more pay for a join.
    The result is written and can be read again.
    """
    for out, more in names.items():
        df = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys, chunk, *more).orderBy(order)))
    run = cut_lineage(df)
    later = run.filter(F.col(chunk) > 0)
    if later.isEmpty():
        return run.drop(chunk)
    for out, more in names.items():
        own = [*keys, *more]
        before = Window.partitionBy(*own).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
        base = run.groupBy(*own, chunk).agg(F.count(F.lit(1)).alias("_total")).withColumn(
            "_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
        later = join_same(later, base, [*own, chunk]).withColumn(out, (F.col(out) + F.col("_base")).cast("int")).drop("_base")
    return run.filter(F.col(chunk) == 0).unionByName(cut_lineage(later)).drop(chunk)


def neighbour(df: DataFrame, keys: list[str], order: str, value: Column, out: str,
              chunk: Column | None = None, following: bool = False) -> DataFrame:
    """Value of the previous (or following) row of the same key, across chunk borders."""
    data = df.withColumn("_chunk", step_chunk(order) if chunk is None else chunk).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    border = Window.partitionBy(*keys).orderBy("_chunk")
    edge = F.min_by("_v", order) if following else F.max_by("_v", order)
    shift = F.lead if following else F.lag
    base = (
        data.groupBy(*keys, "_chunk").agg(edge.alias("_edge"))
        .withColumn("_edge", shift("_edge").over(border))
    )
    rank_end = F.lead(F.lit(1)).over(inside) if following else F.lag(F.lit(1)).over(inside)
    return (
        data.withColumn("_near", shift("_v").over(inside))
        .withColumn("_has", rank_end.isNotNull())
        .join(base, [*keys, "_chunk"])
        .withColumn(out, F.when(F.col("_has"), F.col("_near")).otherwise(F.col("_edge")))
        .drop("_chunk", "_v", "_near", "_has", "_edge")
    )


def following_within(df: DataFrame, keys: list[str], order: str, value: Column, out: str, gap: int,
                     size: int = STEP_CHUNK) -> DataFrame:
    """The next row of the same key if it is at most ``gap`` further along ``order``.

    The first ``gap`` positions of a chunk are also sent to the chunk before, so one window
    per chunk sees every neighbour and no join is needed.
    """
    at = F.col(order)
    chunk = F.floor(at / size)
    homes = F.when(at % size <= gap, F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    d = df.withColumn("_v", value).withColumn("_own", chunk).withColumn("_chunk", F.explode(homes))
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    d = d.withColumn(out, F.lead("_v").over(w)).withColumn("_to", F.lead(order).over(w))
    return d.filter((F.col("_chunk") == F.col("_own")) & (F.col("_to") - at <= gap)).drop("_v", "_own", "_chunk", "_to")


def first_rows(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """First ``n`` rows per key. Spark cuts each input partition to ``n`` rows per key
    before the shuffle (window group limit), so a hot key stays small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
