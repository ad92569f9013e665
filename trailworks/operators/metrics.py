"""Batch, epoch, degradation, reuse and accuracy metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X


def _rate(good: Column, total: Column, places: int = 4) -> Column:
    return F.bround(F.try_divide(good, total), places)


def batch_metrics(results: DataFrame, keys: list[str]) -> DataFrame:
    """A1. ``results``: keys, success, retries_used."""
    n, ok = F.count(F.lit(1)), F.count_if("success")
    return results.groupBy(*keys).agg(
        n.alias("num_results"), ok.alias("success_count"), _rate(ok, n).alias("success_rate"),
        (n - ok).alias("failure_count"), F.sum("retries_used").alias("total_retries"))


def epoch_metrics(results: DataFrame, epoch: str, batch: str) -> DataFrame:
    """A2: epoch and batch levels and the grand total in one pass."""
    n, ok = F.count(F.lit(1)), F.count_if("success")
    return results.rollup(epoch, batch).agg(
        F.grouping_id().alias("level"), n.alias("num_results"), ok.alias("success_count"),
        (n - ok).alias("failure_count"), _rate(ok, n).alias("success_rate"))


def evidence_counters(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """A3. ``attempts``: keys, success, trajectory_available, skipped_files."""
    return attempts.groupBy(*keys).agg(
        F.count_if("success").alias("positive_anchors"), F.count_if(~F.col("success")).alias("failure_attempts"),
        F.count_if(~F.col("success") & ~F.col("trajectory_available")).alias("missing_trajectory_attempts"),
        F.sum("skipped_files").alias("skipped_unreadable_artifacts"))


def degradation(metrics: DataFrame, keys: list[str], order: str, threshold: float = X.DEGRADATION_THRESHOLD) -> DataFrame:
    """Promoted batch against the promoted batch before it.

    ``metrics``: keys, order, promoted, success_rate, total_retries, num_results; one row per
    batch, so a window per family holds one row per batch.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    mean = F.col("total_retries") / F.greatest(F.lit(1), F.col("num_results"))
    d = metrics.filter("promoted").withColumn("_mean", mean)
    d = d.withColumn("prev_rate", F.lag("success_rate").over(w)).withColumn("prev_retries", F.lag("_mean").over(w))
    drop = F.try_divide(F.col("success_rate") - F.col("prev_rate"), F.col("prev_rate"))
    rise = F.try_divide(F.col("_mean") - F.col("prev_retries"), F.col("prev_retries"))
    fell = F.coalesce(drop < -threshold, F.lit(False))
    rose = F.coalesce(rise > threshold, F.lit(False))
    issues = fell.cast("int") + rose.cast("int")
    return d.select(*keys, order, "success_rate", "prev_rate", F.col("_mean").alias("mean_retries"),
                    fell.alias("rate_dropped"), rose.alias("retries_rose"), (issues > 0).alias("degraded"),
                    F.when(issues >= 2, "critical").when(issues == 1, "warning").otherwise("none").alias("severity"))


def trend(metrics: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Direction from the first to the last batch; nothing for a single batch."""
    first, last = F.min_by("success_rate", order), F.max_by("success_rate", order)
    return metrics.groupBy(*keys).agg(first.alias("first_rate"), last.alias("last_rate"),
                                      F.count(F.lit(1)).alias("batches")).filter("batches >= 2").withColumn(
        "trend", F.when(F.col("last_rate") > F.col("first_rate"), "improving")
        .when(F.col("last_rate") < F.col("first_rate"), "degrading").otherwise("stable"))


def reuse_metrics(attempts: DataFrame, used: DataFrame, known: DataFrame, induced: DataFrame,
                  keys: list[str]) -> DataFrame:
    """Exposures and explicit reuse per group.

    ``attempts``: keys, batch, attempt_id, passed. ``used``: attempt_id, slug. ``known``: keys,
    batch, slug, active (policies of the snapshot). ``induced``: keys, batch, slug (policies the
    batch itself produced); the ones already known do not count as new.
    """
    scope = [*keys, "batch"]
    snapshots = known.select(*scope).distinct().withColumn("_exposed", F.lit(1))
    exposure = attempts.join(snapshots, scope, "left").groupBy(*keys).agg(
        F.count("_exposed").alias("policy_exposures"))
    uses = used.distinct().join(attempts.select(*scope, "attempt_id", "passed"), "attempt_id")
    reuse = uses.join(known, [*scope, "slug"]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("explicit_reuses"), F.count_if("passed").alias("successful_reuses"),
        F.count_if("active").alias("active_reuses"),
        F.count_if(F.col("active") & ~F.col("passed")).alias("failed_active_reuses"))
    fresh = induced.join(known.select(*scope, "slug"), [*scope, "slug"], "left_anti")
    same = uses.join(fresh.distinct(), [*scope, "slug"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("same_batch_exposure"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return exposure.join(reuse, keys, "left").join(same, keys, "left").select(
        *keys, *[zero(c) for c in ("policy_exposures", "explicit_reuses", "successful_reuses", "active_reuses",
                                   "failed_active_reuses", "same_batch_exposure")],
        F.try_divide("failed_active_reuses", "active_reuses").alias("false_promotion_rate"),
        F.try_divide("successful_reuses", "explicit_reuses").alias("reuse_success"))


def heldout_accuracy(results: DataFrame, keys: list[str]) -> DataFrame:
    """A10: share of numeric rewards of at least 1; null without any."""
    return results.groupBy(*keys).agg(F.avg((F.col("reward") >= 1.0).cast("int")).alias("heldout_accuracy"))


def ablation_summary(families: DataFrame, results: DataFrame, reuse: DataFrame) -> DataFrame:
    """A11. ``families``: variant, family, final_epoch_successful, total_tasks."""
    keys = ["variant", "family"]
    final = F.when(F.coalesce("total_tasks", F.lit(0)) != 0,
                   F.coalesce("final_epoch_successful", F.lit(0)) / F.col("total_tasks"))
    return families.select(*keys, final.alias("train_final_accuracy")).join(
        heldout_accuracy(results, keys), keys, "left").join(reuse, keys, "left")


def aggregate_accuracy(results: DataFrame) -> DataFrame:
    """A14. ``results``: successful, total per family."""
    ok, n = F.coalesce(F.sum("successful"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))
    return results.agg(F.count(F.lit(1)).alias("families_completed"), ok.alias("test_successful"), n.alias("test_total"),
                       F.coalesce(F.try_divide(ok, n), F.lit(0.0)).alias("accuracy"))


def planned_results(planned: DataFrame, results: DataFrame) -> DataFrame:
    """One row per planned task; a missing result is a failure with reward 0.

    ``results``: task_name, trial_name, success, reward, exception_info, path; the last path wins.
    """
    cols = ["trial_name", "success", "reward", "exception_info", "path"]
    last = results.groupBy("task_name").agg(F.max_by(F.struct(*cols), "path").alias("r"))
    missing = F.col("r").isNull()
    return planned.select("task_name").join(last, "task_name", "left").select(
        "task_name", F.coalesce("r.trial_name", F.lit("")).alias("trial_name"),
        F.coalesce("r.success", F.lit(False)).alias("success"), F.coalesce("r.reward", F.lit(0.0)).alias("reward"),
        F.when(missing, "test attempt produced no result").otherwise(F.col("r.exception_info")).alias("exception_info"))


def final_attempts(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Result of the last attempt and number of retries per task."""
    return attempts.groupBy(*keys).agg(
        F.max_by("success", F.struct("attempt_number", "pos")).alias("final_success"),
        F.greatest(F.max("attempt_number") - 1, F.lit(0)).alias("max_retries"))
