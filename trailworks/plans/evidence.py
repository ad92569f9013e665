"""Main path: steps and attempts to candidates, clusters, gate and store, as one chain of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clustering as CL
from ..operators import memory as M
from ..operators import retrieval as RT
from ..operators import retry as R
from ..operators import trajectory as TR
from ..session import cut_lineage


@dataclass
class Evidence:
    calls: DataFrame
    events: DataFrame
    links: DataFrame
    candidates: DataFrame


def extract(steps: DataFrame, attempts: DataFrame, min_cost: int = 2) -> Evidence:
    """K4: candidates of one batch from spans, reflections, passing substeps and rejections.

    Tool calls feed five consumers and their normalized form two, so the latter is written once.
    """
    events = cut_lineage(TR.normalized_events(TR.tool_calls(steps)))
    calls = events.select(*TR.CALL)
    links = R.retry_links(attempts)
    unique = TR.distinct_substeps(TR.substeps(events), attempts)
    candidates = (
        TR.span_candidates(calls, attempts, min_cost)
        .unionByName(R.reflection_candidates(calls, links))
        .unionByName(TR.substep_candidates(unique))
        .unionByName(TR.rejection_candidates(calls, attempts)))
    return Evidence(calls, events, links, candidates)


def cluster(candidates: DataFrame, vectorizer=None, threshold: float = 0.75, min_occurrences: int = 3,
            assessments: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Publishable clusters and the members of every cluster."""
    # Candidates are read for the points, their texts and the gate: write them once.
    texts = cut_lineage(CL.keyed(candidates.select("candidate_id", "task_name", "evidence_label", *CL.POOL, "intent", "obstacle")))
    clusters, members = CL.group_candidates(texts, threshold, lambda d: RT.hashed_vectors(d, "embedded", vectorizer=vectorizer, copies="copies"))
    gate = CL.cluster_support(members, min_occurrences).filter("publishable")
    return CL.quality_gate(clusters.join(gate, "capability_id"), assessments), members


def store_batch(evidence: Evidence) -> tuple[DataFrame, DataFrame]:
    """Records of one batch: searchable memories and private policy candidates."""
    return M.memory_records(evidence.links), M.policy_candidate_records(evidence.candidates)
