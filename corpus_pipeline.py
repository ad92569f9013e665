"""A corpus pipeline in stages; each is written as Parquet and reread as the next one's documents.

Counted as part of the subpackage ``trailworks.llm``. Rows without a doc_id go through every stage; the
near-duplicate stage neither compares nor drops them. The result holds the token ids of each document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailworks.llm.decontaminate import without_items
from trailworks.llm.near_dedup import near_duplicates
from trailworks.llm.personal_data import redacted
from trailworks.llm.pieces_bpe import token_rows
from trailworks.llm.quality import accepted
from trailworks.llm.tables import documents, stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below 0.7 go."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays: the one with the smallest doc_id.

    Of rows that repeat a doc_id and its text one stays. Rows without a doc_id all stay.
    """
    found = near_duplicates(docs, size=5, percent=80).where("doc_id IS NOT NULL")
    found = stored(found.groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("rows")), "near_duplicates")
    named, nameless = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    single = named.join(found.where("NOT kept OR rows > 1").select("doc_id").hint("merge"), "doc_id", "left_anti")
    repeated = named.join(found.where("kept AND rows > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return single.select(docs.columns).unionByName(repeated.select(docs.columns)).unionByName(nameless)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), any_size=True)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind in brackets; n_chars follows the text."""
    return redacted(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with begin and end, and their number."""
    return token_rows(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("personal_data", hide_personal_data),
    ("encoding", encode),
]

#: A learned model, loopy inference and byte-pair encoding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
