"""Retry links, transitions, episodes and evidence packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import commands as C
from ..functions import fixed as X
from ..functions import text as T
from ..functions.lists import contains_any, non_empty, strip
from ..functions.sequence import chunk_numbers, first_chunk_zero, first_rows
from ..functions.staging import staged
from ..session import cut_lineage
from .trajectory import ATTEMPT, last_failures

MAX_OPERATIONS = 60
MAX_CHANGES = 30
TASK = ["task_family", "task_name"]


def retry_links(attempts: DataFrame) -> DataFrame:
    """Each attempt with a reflection and the outcome of the very next attempt."""
    nxt = attempts.select(*TASK, (F.col("attempt_number") - 1).alias("attempt_number"),
                          F.col("verifier_passed").alias("retry_passed"))
    src = attempts.filter(F.length(F.coalesce("reflection", F.lit(""))) > 0)
    return src.join(nxt, ATTEMPT, "left").withColumn(
        "retry_outcome", F.when(F.col("retry_passed").isNull(), "missing")
        .when(F.col("retry_passed"), "success").otherwise("failure")
    ).withColumn("verified_by_retry", F.col("retry_outcome") == "success")


def operations(events: DataFrame, max_operations: int | None = MAX_OPERATIONS) -> DataFrame:
    """The first parameterized operations of each attempt, in order, written once; all of them if ``max_operations`` is None."""
    rows = events.select(*ATTEMPT, "step_idx", "signature_token", "success", "raw_text")
    if max_operations is None:
        # one attempt may hold a large part of the rows, so its patterns and numbers are made in chunks
        rows = rows.withColumn("_chunk", first_chunk_zero("step_idx")).repartition(*ATTEMPT, "_chunk")
    else:
        rows = first_rows(rows, ATTEMPT, ["step_idx"], max_operations)
    # the patterns run once for each operation that is kept
    rows = staged(rows, _shape=C.command_shape(F.col("raw_text")))
    detail = F.concat(F.col("signature_token"), F.lit(" ["),
                      F.when(F.col("success"), "succeeded").otherwise("failed"), F.lit("]"),
                      F.when(F.length("_shape") > 0, F.concat(F.lit(" "), "_shape")).otherwise(""))
    rows = rows.withColumn("operation", F.substring(detail, 1, 500)).drop("signature_token", "success", "raw_text", "_shape")
    if max_operations is None:
        return chunk_numbers(rows, ATTEMPT, "step_idx", "_chunk", {"pos": [], "copy": ["operation"]}).select(*ATTEMPT, "operation", "pos", "copy")
    w = Window.partitionBy(*ATTEMPT)
    return cut_lineage(rows.select(
        *ATTEMPT, "operation",
        F.row_number().over(w.orderBy("step_idx")).alias("pos"),
        F.row_number().over(Window.partitionBy(*ATTEMPT, "operation").orderBy("step_idx")).alias("copy")))


def retry_changes(events: DataFrame, links: DataFrame, max_operations: int | None = MAX_OPERATIONS,
                  max_changes: int | None = MAX_CHANGES) -> DataFrame:
    """Multiset difference of the operations of an attempt and its retry, long form.

    The k-th copy of an operation matches the k-th copy on the other side, so what has no
    partner is added or removed. ``max_operations`` of an attempt take part and ``max_changes``
    of a kind are returned; None stands for all.
    """
    pairs = cut_lineage(links.filter(F.col("retry_outcome") != "missing").select(*ATTEMPT))
    sides = pairs.unionByName(pairs.withColumn("attempt_number", F.col("attempt_number") + 1)).distinct()
    # both sides read the same operations, so they are made once, for the attempts that are on a side
    ops = operations(events.join(sides, ATTEMPT, "left_semi"), max_operations)
    src = ops.join(pairs, ATTEMPT, "left_semi").withColumnRenamed("pos", "source_pos")
    ret = ops.withColumn("attempt_number", F.col("attempt_number") - 1).join(
        pairs, ATTEMPT, "left_semi").withColumnRenamed("pos", "retry_pos")
    both = src.join(ret, [*ATTEMPT, "operation", "copy"], "full")
    kind = (F.when(F.col("source_pos").isNull(), "added")
            .when(F.col("retry_pos").isNull(), "removed").otherwise("retained"))
    changes = both.select(*ATTEMPT, kind.alias("change"), F.coalesce("retry_pos", "source_pos").alias("pos"), "operation")
    if max_changes is None:
        ranked = chunk_numbers(changes.withColumn("_chunk", first_chunk_zero("pos")), ATTEMPT, "pos", "_chunk", {"rank": ["change"]})
    else:
        w = Window.partitionBy(*ATTEMPT, "change").orderBy("pos")
        ranked = changes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_changes)
    return ranked.select(*ATTEMPT, "change", "rank", "operation")


def retry_transitions(events: DataFrame, links: DataFrame) -> DataFrame:
    """One row per link with the bounded operation lists."""
    changes = retry_changes(events, links)
    pick = lambda name: F.transform(F.array_sort(F.collect_list(F.when(
        F.col("change") == name, F.struct("rank", "operation")))), lambda x: x["operation"])
    lists = changes.groupBy(*ATTEMPT).agg(
        pick("retained").alias("retained_operations"), pick("added").alias("added_operations"),
        pick("removed").alias("removed_operations"))
    empty = F.array().cast("array<string>")
    return links.join(lists, ATTEMPT, "left").select(
        *ATTEMPT, (F.col("attempt_number") + 1).alias("to_attempt"), "retry_outcome", "retry_passed",
        *[F.coalesce(F.col(f"{k}_operations"), empty).alias(f"{k}_operations")
          for k in ("retained", "added", "removed")],
        (F.col("retry_outcome") == "missing").alias("artifact_missing"))


def retry_episodes(attempts: DataFrame, links: DataFrame) -> DataFrame:
    """All attempts of every task that has a reflection, with the final result."""
    tasks = attempts.groupBy(*TASK).agg(
        F.bool_or("verifier_passed").alias("final_success"),
        F.count(F.lit(1)).alias("attempts"),
        F.bool_or(F.length(F.coalesce("reflection", F.lit(""))) > 0).alias("_reflected"),
    ).filter("_reflected").drop("_reflected")
    return (
        attempts.select(*ATTEMPT, "verifier_passed").join(tasks, TASK)
        .join(links.select(*ATTEMPT, "retry_outcome"), ATTEMPT, "left")
    )


def reflection_candidates(calls: DataFrame, links: DataFrame) -> DataFrame:
    """Reflections in the candidate layout; verified only by the retry they guided."""
    f = lambda h: T.parameterize(T.reflection_field(F.col("reflection"), h))
    base = links.filter(F.length(strip(F.col("reflection"))) > 0)
    tail = last_failures(calls, base, "reflection reported a verifier failure").groupBy(*ATTEMPT).agg(
        F.min("step_idx").alias("first_step"), F.max("step_idx").alias("last_step"),
        F.count(F.lit(1)).alias("exploration_cost"))
    return base.join(tail, ATTEMPT).select(
        F.concat_ws(":", "task_name", F.col("attempt_number").cast("string"), F.lit("reflection-1")).alias("candidate_id"),
        *ATTEMPT, "first_step", "last_step", F.lit("").alias("winning_tool"), F.lit("").alias("winning_command"),
        "exploration_cost",
        F.coalesce(non_empty(f("FAILURE OBSERVABLE")), F.lit(X.DEFAULT_INTENT)).alias("intent"),
        F.coalesce(non_empty(f("ROOT CAUSE")), non_empty(f("CAUSAL EVIDENCE")),
                   F.lit(X.DEFAULT_OBSTACLE)).alias("obstacle"),
        F.coalesce(non_empty(f("CORRECTIVE ACTION")), F.lit(X.DEFAULT_RESOLUTION)).alias("resolution"),
        F.when(F.col("verified_by_retry"), "verified_success").otherwise("unresolved_failure").alias("evidence_label"),
        F.lit("reflection").alias("evidence_source"), "retry_outcome",
        F.lit("recovery_candidate").alias("candidate_kind"))


def excerpt(text, limit: int = 4000):
    """Head and tail of a long text with a mark in between."""
    half = limit // 2
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, half), F.lit("\n\n# ... [middle snipped] ...\n\n"), F.right(text, F.lit(half))))


def causal_steps(compact: DataFrame, n: int = 10) -> DataFrame:
    """The last ten action steps of each attempt, redacted and numbered.

    ``compact``: attempt keys, step, action, code.
    """
    acts = compact.filter(contains_any(F.lower("action"), X.CAUSAL_ACTIONS))
    return first_rows(acts, ATTEMPT, [F.desc("step")], n).select(
        *ATTEMPT, F.concat(F.lit("s"), F.col("step").cast("string")).alias("id"), "action",
        T.redact(F.substring("code", 1, 1000)).alias("detail"), "step")


def evidence_packets(attempts: DataFrame, compact: DataFrame, feedback: DataFrame, contracts: DataFrame | None = None,
                     raw: DataFrame | None = None) -> DataFrame:
    """One bounded, redacted packet for each failed attempt.

    ``attempts``: attempt keys, verifier_passed, reward, exception_info. ``compact``: attempt keys, step,
    action, code, the steps selected for evidence (``sampling.select_steps``). ``feedback``: attempt keys, pos,
    name, status, message. ``contracts``: task_family, task_name, objective, constraints. ``raw``: attempt keys,
    text of the trajectory, of which an excerpt stands in where there are no steps.
    """
    short = lambda column, n: T.redact(F.substring(column, 1, n))
    step = compact.select(*ATTEMPT, F.struct("step", F.concat(F.lit("s"), F.col("step").cast("string")).alias("id"), F.coalesce("action", F.lit("agent_action")).alias("action"),
                                             short(F.coalesce("code", F.lit("")), 1000).alias("detail")).alias("s"))
    steps = step.groupBy(*ATTEMPT).agg(F.array_sort(F.collect_list("s")).alias("trajectory_steps"))
    acts = F.filter("trajectory_steps", lambda x: contains_any(F.lower(x["action"]), X.CAUSAL_ACTIONS))
    entry = F.struct("pos", F.coalesce(non_empty(F.col("name")), F.lit("verifier")).alias("name"), F.coalesce(non_empty(F.col("status")), F.lit("unknown")).alias("status"),
                     F.substring(T.redact(F.col("message")), 1, 1000).alias("message"), T.redaction(F.col("message"))["redacted"].alias("redacted"))
    items = first_rows(feedback, ATTEMPT, ["pos"], X.MAX_FEEDBACK).groupBy(*ATTEMPT).agg(F.array_sort(F.collect_list(entry)).alias("verifier_feedback"))
    failed = feedback.filter(F.lower("status") == "failed").groupBy(*ATTEMPT, "name").agg(F.min("pos").alias("pos"))
    failed = first_rows(failed, ATTEMPT, ["pos"], X.MAX_FEEDBACK).groupBy(*ATTEMPT).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("failed_verifier_checks"))
    d = attempts.filter(~F.col("verifier_passed")).select(
        *ATTEMPT, F.coalesce(F.col("reward").cast("double"), F.lit(0.0)).alias("reward"),
        non_empty(F.substring(T.redact(F.col("exception_info")), 1, 2000)).alias("exception"))
    for other in (items, failed, steps):
        d = d.join(other, ATTEMPT, "left")
    if contracts is not None:
        d = d.join(contracts.select("task_family", "task_name", short(F.coalesce("objective", F.lit("")), 2000).alias("objective"), F.transform(
            F.slice("constraints", 1, 10), lambda c: short(c, 500)).alias("constraints")), ["task_family", "task_name"], "left")
    else:
        d = d.withColumn("objective", F.lit("")).withColumn("constraints", F.array().cast("array<string>"))
    d = d.join(raw.select(*ATTEMPT, excerpt(F.col("text")).alias("_raw")), ATTEMPT, "left") if raw is not None else d.withColumn("_raw", F.lit(None).cast("string"))
    none = lambda c: F.coalesce(c, F.array().cast(d.schema[c].dataType))
    bare = lambda a: F.transform(a, lambda x: F.struct(x["id"].alias("id"), x["action"].alias("action"), x["detail"].alias("detail")))
    return d.select(
        *ATTEMPT, "reward", "exception", F.coalesce("objective", F.lit("")).alias("objective"), none("constraints").alias("constraints"),
        none("failed_verifier_checks").alias("failed_verifier_checks"),
        F.transform(none("verifier_feedback"), lambda x: F.struct(x["name"].alias("name"), x["status"].alias("status"), x["message"].alias("message"), x["redacted"].alias("redacted"))).alias("verifier_feedback"),
        bare(none("trajectory_steps")).alias("trajectory_steps"),
        F.coalesce(bare(F.slice(acts, F.greatest(F.size(acts) - X.MAX_CAUSAL_STEPS, F.lit(0)) + 1, F.lit(X.MAX_CAUSAL_STEPS))), F.array().cast("array<struct<id:string,action:string,detail:string>>")).alias("causal_candidates"),
        F.when(F.col("trajectory_steps").isNotNull(), "").otherwise(F.coalesce("_raw", F.lit("(no trajectory available)"))).alias("fallback_trajectory"))
