"""Tabular readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import number


def read_delimited(spark: SparkSession, path: str, columns: list[str], sep: str = ",", numeric: tuple[str, ...] = (),
                   upper: tuple[str, ...] = ()) -> DataFrame:
    """Every column as text, then explicit casts."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    d = spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(path, sep=sep)
    for c in numeric:
        d = d.withColumn(c, F.when(F.col(c).isNotNull(), number(F.col(c))))
    for c in upper:
        d = d.withColumn(c, F.upper(c))
    return d


def check_headers(df: DataFrame, expected: list[str]) -> DataFrame:
    """Exact header check before any work is done."""
    if df.columns != expected:
        raise ValueError(f"unexpected source headers: {df.columns}")
    return df


def flatten(df: DataFrame, path: list[str], keep: list[str] | None = None) -> DataFrame:
    """Explode nested lists level by level. ``path``: list column names from the outside in."""
    cols = list(keep or [])
    d = df
    for i, level in enumerate(path):
        d = d.select(*cols, F.explode(level).alias(f"_{level}"))
        inner = d.schema[f"_{level}"].dataType
        names = [f.name for f in inner.fields if not (i + 1 < len(path) and f.name == path[i + 1])]
        nxt = [path[i + 1]] if i + 1 < len(path) else []
        d = d.select(*cols, *[F.col(f"_{level}.{n}").alias(n if n not in cols else f"{level}_{n}") for n in names],
                     *[F.col(f"_{level}.{n}").alias(n) for n in nxt])
        cols = [c for c in d.columns if c not in nxt]
    return d


def read_nested(spark: SparkSession, path: str, schema: T.StructType, levels: list[str]) -> DataFrame:
    """A JSON export with nested lists, as rows of the innermost list."""
    return flatten(spark.read.schema(schema).option("multiLine", "true").json(path), levels)


def untranspose(df: DataFrame, ids: list[str], value_columns: list[str], name: str, value: str) -> DataFrame:
    """Columns such as weeks become rows."""
    return df.unpivot(ids, value_columns, name, value)


def write_partitioned(df: DataFrame, path: str, partition_by: list[str], fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Batch evidence, diagnostics, memories and metrics, one folder per family, epoch and batch."""
    writer = df.write.mode(mode).format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def append_log(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Evidence log as JSON lines, append only."""
    write_partitioned(df, path, partition_by or [], "json", "append")


def write_report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Audit rows as CSV and JSON, summary as JSON."""
    rows.write.mode("overwrite").option("header", "true").csv(f"{path}/candidate_audit_csv")
    rows.write.mode("overwrite").json(f"{path}/candidate_audit_json")
    summary.write.mode("overwrite").json(f"{path}/audit_summary_json")
