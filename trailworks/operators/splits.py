"""Task splits, order and batching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.commands import is_public_action
from ..functions.sequence import numbered, ordered_numbers
from .trajectory import ATTEMPT


def missing_names(split: DataFrame, tasks: DataFrame) -> DataFrame:
    """K6: split names without a task; must be empty."""
    return split.join(tasks.select("family", "task_name"), ["family", "task_name"], "left_anti")


def ranked_tasks(tasks: DataFrame, ranking: DataFrame) -> DataFrame:
    """K6: ranking first, then name. ``ranking``: family, task_name, rank (first mention counts)."""
    first = ranking.filter(F.length(F.trim("task_name")) > 0).groupBy("family", F.trim("task_name").alias("task_name")).agg(
        F.min("rank").alias("rank"))
    d = tasks.join(first, ["family", "task_name"], "left").withColumn("_order", F.coalesce("rank", F.lit(2**31 - 1)))
    return ordered_numbers(d, ["family"], ["_order", "task_name"], "position").select("family", "task_name", "position")


def split_report(instances: DataFrame, split: DataFrame, train_ratio: float = 0.8) -> DataFrame:
    """K7: per category whether the split is disjoint, complete and of the right size.

    ``instances``: category, task_id. ``split``: category, task_id, part ('train' or 'test').
    """
    s = split.groupBy("category", "task_id").agg(
        F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "test").alias("test"))
    d = instances.select("category", "task_id", F.lit(1).alias("known")).join(s, ["category", "task_id"], "full")
    on = lambda c: F.coalesce(c, F.lit(0)) > 0
    return d.groupBy("category").agg(
        F.count_if(on("train") & on("test")).alias("overlap"),
        F.count_if((F.coalesce("train", F.lit(0)) > 1) | (F.coalesce("test", F.lit(0)) > 1)).alias("duplicates"),
        F.count_if(on("known") & ~on("train") & ~on("test")).alias("missing"),
        F.count_if(~on("known")).alias("extra"),
        F.count_if(on("train")).alias("n_train"), F.count_if(on("test")).alias("n_test"),
        F.greatest(F.lit(1), F.bround(F.sum(F.coalesce("known", F.lit(0))) * F.lit(1 - train_ratio)).cast("long"))
        .alias("expected_test"),
    ).withColumn("valid", (F.col("overlap") + F.col("duplicates") + F.col("missing") + F.col("extra") == 0)
                 & (F.col("n_train") > 0) & (F.col("n_test") == F.col("expected_test")))


def epoch_batches(tasks: DataFrame, keys: list[str], seed: int, epoch: int, batch_size: int) -> DataFrame:
    """K8: deterministic shuffle by hash, cut into batches."""
    d = tasks.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed + epoch}:"), "task_name"), 256))
    ranked = numbered(d, keys, ["_h", "task_name"], "position", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    return ranked.withColumn("batch_index", F.ceil(F.col("position") / batch_size).cast("long")).drop("_h")


def discovery(candidates: DataFrame, attempts: DataFrame, prior: DataFrame | None = None, include_failures: bool = True) -> DataFrame:
    """K9: the candidates that enter clustering in an ablation variant.

    Without failures only passing attempts are looked at, and nothing earlier. With them, candidates of
    earlier batches (``prior``, same columns) join those whose id is new.
    """
    if not include_failures:
        passed = attempts.filter("verifier_passed").select(*ATTEMPT)
        return evidence_filter(candidates.join(passed, ATTEMPT, "left_semi"), False)
    if prior is not None:
        candidates = candidates.unionByName(prior.join(candidates.select("candidate_id"), "candidate_id", "left_anti"))
    return evidence_filter(candidates)


def evidence_filter(candidates: DataFrame, include_failures: bool = True) -> DataFrame:
    """K9: evidence that may enter clustering; ``substep_action`` is null for spans and reflections."""
    public = F.col("substep_action").isNull() | is_public_action(F.col("substep_action"))
    verified = (F.col("evidence_label") == "verified_success") & public
    if not include_failures:
        return candidates.filter(verified)
    return candidates.filter(verified | F.col("evidence_label").isin(*[x for x in X.EVIDENCE_LABELS if x != "verified_success"]))
