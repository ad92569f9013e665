"""Greedy complete-link clustering of candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..functions.staging import staged
from ..session import cut_lineage, shared_folder

POOL = ["task_family", "candidate_kind"]
BLOCK_ROWS = 2048      # vectors of one pool that are placed in one round
MEMBER_CHUNK = 4096    # placed vectors compared by one task


def check_kinds(candidates: DataFrame) -> DataFrame:
    """Candidates of an unknown kind; must be empty."""
    return candidates.filter(~F.col("candidate_kind").isin(*X.CANDIDATE_KINDS)
                             | F.col("candidate_kind").isNull())


def keyed(candidates: DataFrame) -> DataFrame:
    """Candidates with their ``fingerprint`` and the ``embedded`` text; both come from the same masked texts, which are made once."""
    d = staged(candidates, _masked=F.struct(T.cluster_text(F.col("intent")).alias("intent"), T.cluster_text(F.col("obstacle")).alias("obstacle")))
    return d.withColumns({"fingerprint": T.masked_fingerprint(F.col("_masked.intent"), F.col("_masked.obstacle")),
                          "embedded": T.masked_embedding_text(F.col("_masked.intent"), F.col("_masked.obstacle"))}).drop("_masked")


def distinct_points(candidates: DataFrame) -> DataFrame:
    """Exact copies collapsed with their count: twins always share a cluster.

    ``candidates``: POOL, fingerprint, vector (or embedded, the text that a vector is made of later).
    Blocks number the points of a pool in fingerprint order, ``BLOCK_ROWS`` at a time.
    """
    value = "vector" if "vector" in candidates.columns else "embedded"
    points = candidates.groupBy(*POOL, "fingerprint").agg(
        F.count(F.lit(1)).alias("copies"), F.first(value).alias(value))
    from ..functions.sequence import numbered
    # The fingerprint is hexadecimal, so its first digits cut a pool into even ranges.
    ranked = numbered(points, POOL, ["fingerprint"], "_n", F.substring("fingerprint", 1, 3))
    return ranked.withColumn("block", F.floor((F.col("_n") - 1) / BLOCK_ROWS)).drop("_n")


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.map(lambda v: np.asarray(v, dtype=np.float32)).to_list())


def _plain_text(frame: pd.DataFrame) -> pd.DataFrame:
    """Text columns as objects: Arrow-backed text in several chunks is not accepted back."""
    return frame.astype({c: object for c in (*POOL, "fingerprint")})


def _full_matches(batch: DataFrame, placed: DataFrame, threshold: float) -> DataFrame:
    """Clusters all of whose placed members are close to a point of the batch.

    Members are spread over chunks; each chunk reports a cluster only if every member it
    holds passes, and the counts are compared with the cluster size afterwards.
    """
    sizes = placed.groupBy(*POOL, "cluster").agg(F.count(F.lit(1)).alias("size"))
    chunks = placed.groupBy(*POOL).agg(F.ceil(F.count(F.lit(1)) / MEMBER_CHUNK).cast("long").alias("n"))
    members = placed.join(chunks, POOL).withColumn(
        "chunk", F.pmod(F.xxhash64("fingerprint"), F.col("n"))).drop("n")
    spread = batch.join(chunks, POOL).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
    keys = [*POOL, "chunk"]

    def compare(key, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        out = {"fingerprint": [], "cluster": [], "passed": []}
        if not new.empty and not old.empty:
            close = _matrix(new["vector"]) @ _matrix(old["vector"]).T >= np.float32(threshold)
            names, start = np.unique(old["cluster"].to_numpy(), return_inverse=True)
            order = np.argsort(start, kind="stable")
            counts = np.bincount(start)
            edges = np.concatenate([[0], np.cumsum(counts)[:-1]])
            hits = np.add.reduceat(close[:, order].astype(np.int64), edges, axis=1)
            i, j = np.nonzero(hits == counts)
            out = {"fingerprint": new["fingerprint"].to_numpy()[i], "cluster": names[j], "passed": counts[j]}
        frame = pd.DataFrame(out)
        frame.insert(0, POOL[1], key[1])
        frame.insert(0, POOL[0], key[0])
        return _plain_text(frame)

    schema = "task_family string, candidate_kind string, fingerprint string, cluster long, passed long"
    partial = spread.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(compare, schema)
    return (
        partial.groupBy(*POOL, "fingerprint", "cluster").agg(F.sum("passed").alias("passed"))
        .join(sizes, [*POOL, "cluster"]).filter(F.col("passed") == F.col("size"))
        .groupBy(*POOL, "fingerprint").agg(F.array_sort(F.collect_list("cluster")).alias("open"))
    )


def _place(threshold: float, first_cluster: int):
    """Sequential first-fit of one bounded block."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fingerprint", kind="stable").reset_index(drop=True)
        m = _matrix(pdf["vector"])
        close = m @ m.T >= np.float32(threshold)
        grown: dict[int, list[int]] = {}     # members that this block added
        fresh: list[int] = []                # clusters opened by this block, in order
        result = np.empty(len(pdf), dtype=np.int64)
        for i, opened in enumerate(pdf["open"]):
            older = [] if opened is None else [int(c) for c in opened]
            chosen = None
            for c in [*older, *fresh]:
                if all(close[i, k] for k in grown.get(c, ())):
                    chosen = c
                    break
            if chosen is None:
                chosen = first_cluster + len(fresh)
                fresh.append(chosen)
            grown.setdefault(chosen, []).append(i)
            result[i] = chosen
        return _plain_text(pdf.drop(columns=["open"]).assign(cluster=result))
    return run


def cluster_points(candidates: DataFrame, threshold: float = X.CLUSTER_SIMILARITY) -> DataFrame:
    """Each point joins the first cluster whose every member is close to it.

    The rule is sequential in fingerprint order. It runs in rounds of one block per pool:
    comparing the block with everything placed before is distributed, only the block itself
    is walked in order. A pool of up to ``BLOCK_ROWS`` distinct points needs one round.
    """
    return place_points(cut_lineage(distinct_points(candidates)), threshold)


def place_points(points: DataFrame, threshold: float = X.CLUSTER_SIMILARITY) -> DataFrame:
    """C1 for distinct points (POOL, fingerprint, copies, vector, block), which are read once for each block."""
    last = points.agg(F.max("block")).first()[0]
    placed, folder = None, shared_folder(points.sparkSession, "clusters")
    # Cluster numbers of round r start at r * BLOCK_ROWS: later rounds sort behind earlier ones.
    for block in range(0, int(last) + 1 if last is not None else 0):
        batch = points.filter(F.col("block") == block)
        if placed is None:
            joined = batch.withColumn("open", F.lit(None).cast("array<bigint>"))
        else:
            joined = batch.join(_full_matches(batch, placed, threshold), [*POOL, "fingerprint"], "left")
        schema = ("task_family string, candidate_kind string, fingerprint string, copies long, "
                  f"vector {points.schema['vector'].dataType.simpleString()}, block long, cluster long")
        done = joined.select(*POOL, "fingerprint", "copies", "vector", "block", "open").groupBy(*POOL).applyInPandas(
            _place(threshold, block * BLOCK_ROWS), schema)
        if int(last) == 0:
            return done
        # each round adds its block to one table, so that its plan and its tasks do not grow with the rounds before
        done.write.mode("append").parquet(folder)
        placed = points.sparkSession.read.schema(done.schema).parquet(folder)
    if placed is None:
        return points.withColumn("cluster", F.lit(0).cast("long"))
    return placed


def representatives(placed: DataFrame) -> DataFrame:
    """Point with the highest mean similarity to all others, copies counted.

    The mean over the others is (v . S - v . v) / (N - 1) with S the sum over all copies,
    so no pair of members is formed.
    """
    key = [*POOL, "cluster"]
    sums = (
        placed.select(*key, "copies", F.posexplode("vector").alias("pos", "x"))
        .groupBy(*key, "pos").agg(F.sum(F.col("x").cast("double") * F.col("copies")).alias("s"))
        .groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("sum"))
    )
    sizes = placed.groupBy(*key).agg(F.sum("copies").alias("members"))
    d = placed.join(sums.join(sizes, key), key)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    v = F.transform("vector", lambda x: x.cast("double"))
    total = F.transform("sum", lambda e: e["s"])
    score = F.when(F.col("members") > 1, (dot(v, total) - dot(v, v)) / (F.col("members") - 1)).otherwise(0.0)
    # Ties go to the smaller fingerprint; sums in double are rounded so that ties are ties.
    return d.withColumn("mean_similarity", F.round(score, 6)).groupBy(*key).agg(
        F.first("members").alias("members"),
        F.min_by("fingerprint", F.struct(-F.col("mean_similarity"), F.col("fingerprint"))).alias("representative"),
        F.max("mean_similarity").alias("mean_similarity"))


def group_candidates(candidates: DataFrame, threshold: float = X.CLUSTER_SIMILARITY, vectorize=None) -> tuple[DataFrame, DataFrame]:
    """(clusters, members). ``candidates``: candidate columns and ``vector``.

    With ``vectorize`` candidates have no vector but are ``keyed``: it gets each distinct text once
    (embedded, copies) and adds ``vector``. A vector is then made and kept for each point, not for each candidate.
    """
    if vectorize is None:
        d = candidates.withColumn("fingerprint", T.fingerprint(F.col("intent"), F.col("obstacle")))
        points = distinct_points(d.select(*POOL, "fingerprint", "vector"))
    else:
        d = candidates
        points = cut_lineage(distinct_points(d.select(*POOL, "fingerprint", "embedded")))
        vectors = vectorize(d.groupBy("embedded").agg(F.count(F.lit(1)).alias("copies"))).select("embedded", "vector")
        points = points.join(vectors, "embedded").select(*POOL, "fingerprint", "copies", "vector", "block")
    placed = cut_lineage(place_points(cut_lineage(points), threshold))
    reps = representatives(placed)
    texts = d.groupBy(*POOL, "fingerprint").agg(F.min_by("intent", "candidate_id").alias("intent"),
                                                F.min_by("obstacle", "candidate_id").alias("obstacle"))
    named = reps.join(texts.withColumnRenamed("fingerprint", "representative"), [*POOL, "representative"])
    key = F.concat_ws("\x1f", "candidate_kind", T.cluster_text(F.col("intent")), T.cluster_text(F.col("obstacle")),
                      F.lit(X.CLUSTER_ALGORITHM))
    clusters = named.select(
        F.concat(F.lit("cap-semantic-v2-"), F.substring(F.sha2(key, 256), 1, 12)).alias("capability_id"),
        *POOL, "cluster", "members", "intent", "obstacle", "mean_similarity")
    members = (
        d.select("candidate_id", "task_name", "evidence_label", *POOL, "fingerprint")
        .join(placed.select(*POOL, "fingerprint", "cluster"), [*POOL, "fingerprint"])
        .join(clusters.select("capability_id", *POOL, "cluster"), [*POOL, "cluster"])
        .select("capability_id", *POOL, "candidate_id", "task_name", "evidence_label"))
    return clusters, members


def cluster_support(members: DataFrame, min_occurrences: int = X.MIN_OCCURRENCES) -> DataFrame:
    """Distinct tasks per cluster and the publication gate."""
    qualifies = F.col("evidence_label").isin("verified_success", "unresolved_failure")
    return members.groupBy("capability_id").agg(
        F.count_distinct("task_name").alias("support"),
        F.count_distinct(F.when(qualifies, F.col("task_name"))).alias("qualifying_tasks"),
        F.bool_or(F.col("evidence_label") == "verified_success").alias("verified"),
    ).withColumn("publishable", F.col("qualifying_tasks") >= min_occurrences)


def quality_gate(clusters: DataFrame, assessments: DataFrame | None,
                 min_confidence: float = X.MIN_QUALITY_CONFIDENCE) -> DataFrame:
    """Without an assessment table all pass; with one, only assessed high-quality clusters."""
    if assessments is None:
        return clusters
    good = assessments.filter(
        (F.coalesce("quality", F.lit("low")) == "high") & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence))
    return clusters.join(good.select(F.col("cluster_id").alias("capability_id")), "capability_id", "left_semi")
