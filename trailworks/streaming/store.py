"""A table that micro-batches change: bucketed files, a log of versions, bounded history.

Rows are dealt to buckets by the hash of their key. A version is a folder with the buckets that its
micro-batch touched, written from those buckets of the version before and the batch:

    <store>/version=<v>/bucket=<b>/part-*.parquet
    <store>/log/version=<v>/part-*.parquet      (bucket, held_by): which version's files are valid for each bucket

The log of a version is written after its files and names all buckets, so a reader sees a version whole or
not at all, and only ``buckets`` rows of it are ever read on the driver. A batch that is run again writes
the same folders again from the same version before. Versions older than the ``retain`` last ones lose
their logs, and files that no remaining log names are removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

BUCKETS, RETAIN = 64, 5
_LOG = "bucket int, held_by long, columns string"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, folder: str, name: str = "version=") -> list[int]:
    """Versions that have a folder, oldest first."""
    fs, path = _files(spark, folder)
    found = fs.listStatus(path) if fs.exists(path) else []
    return sorted(int(f.getPath().getName().removeprefix(name)) for f in found if f.getPath().getName().startswith(name))


def _log(spark: SparkSession, store: str, version: int) -> tuple[dict[int, int], T.StructType]:
    rows = spark.read.schema(_LOG).parquet(f"{store}/log/version={version}").collect()
    columns = next(r.columns for r in rows if r.bucket == -1)
    return {r.bucket: r.held_by for r in rows if r.bucket >= 0}, T.StructType.fromJson(json.loads(columns))


def _rows(spark: SparkSession, store: str, held: dict[int, int], columns: T.StructType) -> DataFrame:
    if not held:
        return spark.createDataFrame([], columns)
    paths = [f"{store}/version={v}/bucket={b}" for b, v in sorted(held.items())]
    return spark.read.schema(columns).parquet(*paths)


def read_store(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one by default."""
    return _rows(spark, store, *_log(spark, store, versions(spark, f"{store}/log")[-1] if version is None else version))


def apply_batch(store: str, version: int, batch: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame],
                buckets: int = BUCKETS, retain: int = RETAIN) -> None:
    """Write ``version`` from the version before it and ``batch`` (one row for each key).

    ``merge(old, new)`` gets the rows of the touched buckets and the batch. Null keys share a bucket.
    ``buckets`` must stay the same for a store.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = cut_lineage(batch)        # read to find the buckets and again to merge
    touched = {r[0] for r in new.select(bucket).distinct().collect()}
    earlier = [v for v in versions(spark, f"{store}/log") if v < version]
    held, columns = _log(spark, store, earlier[-1]) if earlier else ({}, new.schema)
    old = _rows(spark, store, {b: v for b, v in held.items() if b in touched}, columns)
    merged = merge(old, new) if held else new
    if touched:
        merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/version={version}")
        held, columns = held | dict.fromkeys(touched, version), merged.schema
    log = [(-1, version, columns.json())] + [(b, v, None) for b, v in sorted(held.items())]
    spark.createDataFrame(log, _LOG).coalesce(1).write.mode("overwrite").parquet(f"{store}/log/version={version}")
    forget(spark, store, retain)


def forget(spark: SparkSession, store: str, retain: int = RETAIN) -> None:
    """Remove the logs before the last ``retain`` versions, and all files that no log names."""
    kept = versions(spark, f"{store}/log")[-retain:]
    named = {(v, b) for k in kept for b, v in _log(spark, store, k)[0].items()}
    fs, root = _files(spark, store)

    def remove(path: str) -> None:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{path}"), True)

    for v in versions(spark, f"{store}/log"):
        if v not in kept:
            remove(f"log/version={v}")
    for v in versions(spark, store):
        if v > kept[-1]:
            continue        # a batch in flight
        here = versions(spark, f"{store}/version={v}", "bucket=")
        gone = [b for b in here if (v, b) not in named]
        for b in gone if len(gone) < len(here) else []:
            remove(f"version={v}/bucket={b}")
        if len(gone) == len(here):
            remove(f"version={v}")
