"""Experience store: build, merge, mark, rehydrate, migrate, backfill
(SURVEY J4-J6, J8, A4, C5, C6, R4, R5, P29).

The store is two tables keyed by ``memory_id``: ``memories`` (searchable reflection
episodes) and ``policy_candidates`` (private consolidation state). Both carry
``representation`` and ``candidate_id``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..functions.lists import non_empty, squeeze, strip
from .trajectory import ATTEMPT

MEMORY_PROMOTED = "memory_residual"
CANDIDATE_PROMOTED = "skill_factored"


def transition_summary(retry_outcome: Column, attempt: Column) -> Column:
    """The three fields of a retry transition that a store keeps."""
    passed = F.when(retry_outcome == "success", F.lit(True)).when(retry_outcome == "failure", F.lit(False))
    return F.struct(attempt.alias("from_attempt"), passed.alias("retry_verifier_passed"),
                    (attempt + 1).alias("to_attempt"))


def memory_records(links: DataFrame) -> DataFrame:
    """One searchable record per reflection."""
    d = links.withColumn("f", T.memory_fields(F.col("reflection"))).select(
        *ATTEMPT, F.concat_ws(":", "task_name", F.col("attempt_number").cast("string"),
                              F.lit("reflection-1")).alias("candidate_id"),
        "f.*", "retry_outcome",
        F.when(F.col("verified_by_retry"), "verified_success").otherwise("unresolved_failure").alias("outcome"),
        "verified_by_retry",
        transition_summary(F.col("retry_outcome"), F.col("attempt_number")).alias("retry_transition"),
        F.lit("memory").alias("representation"))
    # A memory has no cluster input, so the identity carries a null intent.
    null = F.lit(None).cast("string")
    return d.withColumn("memory_id", T.canonical_memory_id(
        F.col("attempt_number"), null, null, F.col("lesson"), F.col("rationale"),
        F.col("retry_outcome"), F.col("retry_transition"), F.col("task_family"), F.col("task_name")))


def policy_candidate_records(candidates: DataFrame) -> DataFrame:
    """Parameterized evidence kept for consolidation across batches."""
    has_transition = F.col("retry_outcome").isNotNull()
    d = candidates.withColumn("_transition", F.when(has_transition, F.to_json(
        transition_summary(F.col("retry_outcome"), F.col("attempt_number")), {"ignoreNullFields": "false"}))
        .otherwise("{}"))
    # The identity is hashed over text, so the nested object is spliced into the JSON.
    head = F.to_json(F.struct(
        F.lit(None).cast("int").alias("attempt_number"), F.col("candidate_kind"), F.col("intent"),
        F.col("resolution").alias("lesson"), F.col("obstacle").alias("rationale"),
        F.col("retry_outcome")), {"ignoreNullFields": "false"})
    tail = F.to_json(F.struct("task_family", "task_name"), {"ignoreNullFields": "false"})
    payload = F.concat(F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(',"retry_transition":'),
                       F.col("_transition"), F.lit(","), F.expr("substring(_tail, 2)"))
    return (
        d.withColumn("_head", head).withColumn("_tail", tail)
        .withColumn("memory_id", F.concat(F.lit("memory-"), F.substring(F.sha2(payload, 256), 1, 20)))
        .select("memory_id", "candidate_id", "task_family", "task_name", "candidate_kind", "evidence_source",
                F.col("intent").alias("observation"), F.col("evidence_label").alias("outcome"),
                "retry_outcome", F.col("resolution").alias("lesson"), F.col("obstacle").alias("rationale"),
                "intent", "obstacle", F.lit("candidate").alias("representation"))
    )


def last_per_id(records: DataFrame, order: str) -> DataFrame:
    """Later rows of the same id win; partial aggregation keeps hot ids small."""
    cols = [c for c in records.columns if c != "memory_id"]
    return records.groupBy("memory_id").agg(F.max_by(F.struct(*cols), F.col(order)).alias("r")).select("memory_id", "r.*")


def merge_store(store: DataFrame, batch: DataFrame, promoted: str) -> DataFrame:
    """Upsert by id. New fields win where given, a promoted representation stays."""
    cols = [c for c in batch.columns if c != "memory_id"]
    old = store.select("memory_id", F.struct(*[c for c in store.columns if c != "memory_id"]).alias("o"))
    new = batch.select("memory_id", F.struct(*cols).alias("n"))
    out = []
    for c in dict.fromkeys([*store.columns, *cols]):
        if c == "memory_id":
            out.append("memory_id")
        elif c == "representation":
            out.append(F.when(F.col("o.representation") == promoted, F.lit(promoted))
                       .otherwise(F.coalesce("n.representation", "o.representation")).alias(c))
        elif c in cols and c in store.columns:
            out.append(F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.col(f"{'n' if c in cols else 'o'}.{c}").alias(c))
    return old.join(new, "memory_id", "full").select(*out)


def mark_compiled(memories: DataFrame, candidates: DataFrame, compiled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records named by memory id or candidate id; memories also through the
    candidate id of a compiled candidate. ``compiled``: one column ``id``."""
    ids = compiled.select("id").distinct()
    key = F.coalesce("candidate_id", F.lit(""))

    def hit(records: DataFrame, names: DataFrame, column: str, flag: str) -> DataFrame:
        return records.join(names.select(F.col("id").alias(column), F.lit(True).alias(flag)), column, "left")

    marked = hit(hit(candidates.withColumn("_cid", key), ids, "memory_id", "_a"), ids, "_cid", "_b")
    yes = F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False))
    done = marked.withColumn("_hit", yes)
    sources = done.filter("_hit").select(F.col("_cid").alias("id")).unionByName(ids).distinct()
    new_candidates = done.withColumn(
        "representation", F.when(F.col("_hit"), CANDIDATE_PROMOTED).otherwise(F.col("representation"))
    ).select(*candidates.columns)
    mem = hit(hit(memories.withColumn("_cid", key), ids, "memory_id", "_a"), sources, "_cid", "_b")
    new_memories = mem.withColumn(
        "representation", F.when(yes, MEMORY_PROMOTED).otherwise(F.col("representation"))).select(*memories.columns)
    return new_memories, new_candidates


def store_counts(memories: DataFrame, candidates: DataFrame) -> DataFrame:
    """A4: both tables in one aggregate."""
    both = memories.select(F.lit(True).alias("mem"), "representation").unionByName(
        candidates.select(F.lit(False).alias("mem"), "representation"))
    m, c, r = F.col("mem"), ~F.col("mem"), F.col("representation")
    return both.agg(
        F.count_if(m).alias("total"), F.count_if(m & (r == "memory")).alias("unpromoted"),
        F.count_if(m & (r == MEMORY_PROMOTED)).alias("skill_factored"), F.count_if(c).alias("policy_candidates"),
        F.count_if(c & (r == "candidate")).alias("pending_policy_candidates"),
        F.count_if(c & (r == CANDIDATE_PROMOTED)).alias("compiled_policy_candidates"))


def pending_candidates(candidates: DataFrame) -> DataFrame:
    """J6 part: unpromoted candidates of earlier batches, cleaned up for clustering."""
    def allowed(column: str, values, default: str) -> Column:
        return F.when(F.col(column).isin(*values), F.col(column)).otherwise(default)

    return candidates.filter(F.col("representation") == "candidate").select(
        F.col("memory_id").alias("candidate_id"),
        F.coalesce("task_family", F.lit("")).alias("task_family"),
        F.coalesce(non_empty(F.col("task_name")), F.lit("unknown-task")).alias("task_name"),
        F.lit(1).alias("exploration_cost"),
        F.coalesce(non_empty(F.col("intent")), F.lit("recover from a prior task failure")).alias("intent"),
        F.coalesce(non_empty(F.col("obstacle")), F.col("rationale"), F.lit("")).alias("obstacle"),
        F.coalesce("lesson", F.lit("")).alias("resolution"),
        allowed("outcome", X.EVIDENCE_LABELS, "unresolved_failure").alias("evidence_label"),
        allowed("evidence_source", ("trajectory", "reflection"), "reflection").alias("evidence_source"),
        "retry_outcome",
        allowed("candidate_kind", X.CANDIDATE_KINDS, "recovery_candidate").alias("candidate_kind"))


def add_prior(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Earlier candidates whose id is not in the current batch."""
    return current.unionByName(prior.join(current.select("candidate_id"), "candidate_id", "left_anti"),
                               allowMissingColumns=True)


def public_view(memories: DataFrame) -> DataFrame:
    """Compiled memories lose their procedure and get the fixed lesson."""
    promoted = F.col("representation") == MEMORY_PROMOTED
    private = [c for c in ("intent", "obstacle", "substep") if c in memories.columns]
    d = memories.withColumn("lesson", F.when(promoted, F.lit(X.RESIDUAL_LESSON)).otherwise(F.col("lesson")))
    for c in private:
        d = d.withColumn(c, F.when(~promoted, F.col(c)))
    return d


def get_memory(memories: DataFrame, memory_id: str) -> DataFrame:
    """R4"""
    return memories.filter(F.col("memory_id") == memory_id).drop("retrieval_embedding")


def migrate_v1(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Schema v1 kept every candidate as a memory. Split into (memories, candidates)."""
    reflected = (
        (F.size(F.coalesce("reflection_files", F.array().cast("array<string>"))) > 0)
        | (F.coalesce("evidence_source", F.lit("")) == "reflection")
        | F.coalesce("candidate_id", F.lit("")).contains(":reflection-"))
    candidates = records.withColumn("representation", F.when(
        F.col("representation") == MEMORY_PROMOTED, CANDIDATE_PROMOTED).otherwise("candidate"))
    return records.filter(reflected).withColumn("memory_kind", F.lit("reflection_episode")), candidates


def lineage_matches(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """Records whose origin is in the published lineage.

    ``records``: memory_id, task_name, source, outcome, retry_outcome, lesson.
    ``evidence``: task_fingerprint, source, label, retry_outcome, resolution.
    Evidence is reduced to its distinct provenance first: per task a handful of
    (source, label, outcome) combinations, so a hot task never produces all pairs.
    """
    norm = lambda c: strip(squeeze(F.coalesce(c, F.lit(""))))
    r = records.filter(F.length(F.coalesce("task_name", F.lit(""))) > 0).select(
        "memory_id", T.task_fingerprint(F.col("task_name")).alias("task_fingerprint"),
        "source", "outcome", "retry_outcome", norm(F.col("lesson")).alias("_text"))
    e = evidence.select("task_fingerprint", F.col("source").alias("e_source"), F.col("label").alias("e_label"),
                        F.col("retry_outcome").alias("e_retry"), norm(F.col("resolution")).alias("_text"))

    def agrees(a: str, b: str) -> Column:
        blank = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) == 0
        return blank(a) | blank(b) | (F.col(a) == F.col(b))

    retry = F.col("retry_outcome").isNull() | F.col("e_retry").isNull() | (F.col("retry_outcome") == F.col("e_retry"))
    same = reduce(lambda x, y: x & y, [agrees("source", "e_source"), agrees("outcome", "e_label"), retry])
    exact = r.join(e.distinct(), ["task_fingerprint", "_text"]).filter(same).select(
        "memory_id", F.lit(1).alias("rank"))
    kinds = e.drop("_text").distinct()
    provenance = r.filter(F.col("source") == "trajectory").join(kinds, "task_fingerprint").filter(same).select(
        "memory_id", F.lit(2).alias("rank"))
    return exact.unionByName(provenance).groupBy("memory_id").agg(F.min("rank").alias("rank")).select(
        "memory_id", F.when(F.col("rank") == 1, "exact_resolution").otherwise("trajectory_provenance").alias("mode"))


def backfill(records: DataFrame, memories: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One store from all historic batches. Returns (memories, candidates, provenance)."""
    matches = lineage_matches(
        records.withColumnRenamed("evidence_source", "source"), evidence)
    mem, cand = mark_compiled(memories, records, matches.select(F.col("memory_id").alias("id")))
    tag = lambda d, name: d.select(name.alias("what"))
    rows = tag(matches, F.col("mode")).unionByName(tag(mem, F.lit("memory"))).unionByName(
        tag(cand, F.lit("candidate"))).unionByName(tag(evidence, F.lit("evidence")))
    n = lambda what: F.count_if(F.col("what") == what)
    return mem, cand, rows.agg(
        n("exact_resolution").alias("exact_resolution_candidates"),
        n("trajectory_provenance").alias("trajectory_provenance_candidates"),
        n("memory").alias("retrieval_memories"), n("candidate").alias("policy_candidates"), n("evidence").alias("lineage_evidence"))
