"""Shards of a global random order: a two-pass external shuffle.

Pass 1 scatters the rows by a seeded hash into buckets that fit in memory. Pass 2 puts each bucket in
a fixed order and shuffles it (Fisher-Yates, seeded by the bucket). The buckets one after the other
are a random order of all rows; it is cut into shards whose row counts differ by one at most. Only the
counts of the buckets, one small row each, are summed up over all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import shared_path

SHARDS, SEED = 40, 2024
#: What a bucket may hold on average. Buckets are loaded whole; hashes spread them evenly.
BUCKET_BYTES, BUCKET_ROWS = 32 << 20, 20_000


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A random order of n rows: from the last place down, swap with a place up to it."""
    order = np.arange(n)
    swap = (np.random.default_rng(seed).random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    order = order.tolist()
    for i in range(n - 1, 0, -1):
        j = swap[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def shuffled(rows: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED, bucket_rows: int | None = None) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, in a random order that depends on seed and content only.

    ``keys`` name the columns that scatter and order the rows; rows equal in all of them are
    interchangeable and share a bucket, so the keys should tell rows apart. Nulls are values like
    others. Shards hold floor or ceil of rows / shards; with fewer rows than shards some are empty.
    Slots count from 0 in each shard. Input columns named shard or slot give way to the new ones.
    """
    total = rows.count()
    buckets = max(1, -(-total // (bucket_rows or BUCKET_ROWS)))
    order = [f"_key{k}" for k in range(len(keys))]
    dealt = (
        rows.select(F.struct("*").alias("_row"), *(F.col(c).alias(k) for c, k in zip(keys, order)))
        .withColumn("_order", F.xxhash64(*order, F.lit(seed)))
        .withColumn("_bucket", F.pmod(F.xxhash64("_order"), F.lit(buckets)).cast("int"))
    )
    counts = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = counts.select("_bucket", (F.sum("_n").over(up_to) - F.col("_n")).alias("_before"))

    def work(table: pa.Table) -> pa.Table:
        bucket = table.column("_bucket")[0].as_py() if len(table) else 0
        table = table.sort_by([(c, "ascending") for c in ("_order", *order)])
        table = table.take(pa.array(fisher_yates(len(table), [seed, bucket]))).select(["_row", "_bucket"])
        return table.append_column("_place", pa.array(np.arange(len(table))))

    made = dealt.select("_row", "_bucket").schema.add("_place", "long")
    # ranges of buckets, so that the rows come out along their places and need not be dealt out again to be written
    mixed = dealt.repartitionByRange("_bucket").groupBy("_bucket").applyInArrow(work, made)
    # one narrow row for each bucket: sent to the tasks, so that the rows are not dealt out again
    placed = mixed.join(F.broadcast(before), "_bucket").withColumn("_place", F.col("_place") + F.col("_before"))
    # shard s holds the places from floor(s * total / shards) on
    return (
        placed.withColumn("shard", F.expr(f"int(((_place + 1) * {shards}L - 1) div {max(total, 1)}L)"))
        .withColumn("slot", F.expr(f"_place - (shard * {total}L) div {shards}L"))
        .select(*(F.col("_row")[c].alias(c) for c in rows.columns if c not in ("shard", "slot")), "shard", "slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, keys: list[str] | None = None) -> None:
    """Write whole documents, a folder for each shard; its files, and the rows in them, follow the slots.

    ``keys`` are those of ``shuffled``, all columns if not given.
    """
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.count(F.lit(1))).first()
    mean = max(1, (size[0] or 0) // max(1, size[1]))
    rows = shuffled(docs, keys or docs.columns, shards, seed, max(1, min(BUCKET_ROWS, BUCKET_BYTES // mean)))
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each document.

    The law is ``rows``: counts of shards differ by one at most. Size is the bytes of the text plus
    16, null texts count as empty. The whole documents are written to shards in the shared folder; the
    report is read from those.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = F.octet_length(text).cast("long") + 16, F.crc32(text.cast("binary"))
    path = shared_path(docs.sparkSession, "shards")
    # the texts travel once, as rows; digests of them scatter and order the rows
    keyed = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "_size": size, "_crc32": crc})
    write_shards(keyed, path, shards, seed, ["doc_id", "_size", "_crc32"])
    return docs.sparkSession.read.schema("doc_id long, text string, slot long, shard int").parquet(path).select(
        "doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
