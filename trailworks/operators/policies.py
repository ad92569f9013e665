"""Policy registry: upsert, promotion, near-duplicates, observation lists
(SURVEY C4, J7, J11, A15-A18, W7, W8, K1)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..functions.sequence import first_rows
from ..session import cut_lineage
from .overlap import rarest_tokens

BLOCK_ROWS = 2000


def distinct_observations(members: DataFrame, key: str, columns: list[str], limit: int | None = None,
                          order: str = "pos") -> DataFrame:
    """Ordered distinct observations per key, optionally the first ``limit``, long form."""
    first = members.groupBy(key, *columns).agg(F.min(order).alias("first_pos"))
    if limit is not None:
        first = first_rows(first, [key], ["first_pos", *columns], limit)
    return first


def upsert_policies(policies: DataFrame, proposals: DataFrame) -> DataFrame:
    """C4: proposals replace the contract text, identity and status stay; new ones are experimental."""
    text = ["name", "purpose", "trigger", "invariants", "recovery"]
    o = policies.select("policy_id", F.struct(*[c for c in policies.columns if c != "policy_id"]).alias("o"))
    n = proposals.select("policy_id", F.struct(*[c for c in proposals.columns if c != "policy_id"]).alias("n"))
    d = o.join(n, "policy_id", "full")
    return d.select(
        "policy_id",
        *[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in text],
        F.coalesce("o.slug", T.slug(F.col("n.name"))).alias("slug"),
        F.coalesce("o.status", F.lit("experimental")).alias("status"),
        F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "kept")
        .when(F.exists(F.array(*[~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in text]), lambda x: x), "updated")
        .otherwise("unchanged").alias("change"))


def merge_distinct(stored: DataFrame, new: DataFrame) -> DataFrame:
    """C4: child rows (observations, resolution evidence) added unless equal to a stored one."""
    return stored.unionByName(new).distinct()


def upsert_implementations(stored: DataFrame, proposals: DataFrame) -> DataFrame:
    """C4: one implementation slot per policy; a changed procedure restarts as experimental."""
    s = stored.select("policy_id", F.struct("trigger", "procedure", "status").alias("o"))
    p = proposals.select("policy_id", F.struct("trigger", "procedure").alias("n"))
    same = F.col("o.trigger").eqNullSafe(F.col("n.trigger")) & F.col("o.procedure").eqNullSafe(F.col("n.procedure"))
    keep_old = F.col("n").isNull() | (F.col("o").isNotNull() & same)
    d = s.join(p, "policy_id", "full").withColumn("_keep", keep_old)
    return d.select(
        "policy_id", F.concat(F.lit("implementation-"), F.substring(T.slug(F.col("policy_id")), 1, 32), F.lit("-"),
                              F.substring(F.sha2("policy_id", 256), 1, 8)).alias("implementation_id"),
        F.when(F.col("_keep"), F.col("o.trigger")).otherwise(F.col("n.trigger")).alias("trigger"),
        F.when(F.col("_keep"), F.col("o.procedure")).otherwise(F.col("n.procedure")).alias("procedure"),
        F.when(F.col("_keep"), F.col("o.status")).otherwise("experimental").alias("status"))


def promotions(policies: DataFrame, observations: DataFrame, attempts: DataFrame, used: DataFrame,
               strict_cross_task: bool = False, require_policy_use: bool = True) -> DataFrame:
    """Status and reuse evidence count per policy.

    ``policies``: policy_id, slug, status. ``observations``: policy_id, task_fingerprint.
    ``attempts``: attempt_id, task_name, verifier_passed. ``used``: attempt_id, name (policy id or slug).
    Explicit use is an equi-join on the used name. Without that condition every passing
    attempt counts, which is a total minus the policy's own tasks, not a cross product.
    """
    origins = observations.select("policy_id", "task_fingerprint").distinct()
    owned = policies.join(origins.select("policy_id").distinct(), "policy_id", "left_semi")
    passing = attempts.filter("verifier_passed").select(
        "attempt_id", T.task_fingerprint(F.col("task_name")).alias("task_fingerprint"))
    if require_policy_use:
        names = owned.select("policy_id", F.explode(F.array_distinct(F.array("policy_id", "slug"))).alias("name"))
        hits = used.distinct().join(names, "name").select("attempt_id", "policy_id").distinct().join(
            passing, "attempt_id")
        if strict_cross_task:
            hits = hits.join(origins, ["policy_id", "task_fingerprint"], "left_anti")
        evidence = hits.groupBy("policy_id").agg(F.count_distinct("task_fingerprint", "attempt_id").alias("evidence"))
    else:
        total = passing.agg(F.count(F.lit(1)).alias("_total"))
        own = passing.join(origins, "task_fingerprint").groupBy("policy_id").agg(F.count(F.lit(1)).alias("_own"))
        evidence = owned.select("policy_id").join(own, "policy_id", "left").join(F.broadcast(total)).select(
            "policy_id", (F.col("_total") - (F.coalesce("_own", F.lit(0)) if strict_cross_task else F.lit(0)))
            .alias("evidence"))
    n = F.coalesce("evidence", F.lit(0))
    return policies.join(evidence, "policy_id", "left").select(
        "policy_id", "slug", F.when(n > 0, "active").otherwise(F.col("status")).alias("status"), n.alias("evidence"),
        ((n > 0) & (F.col("status") != "active")).alias("promoted"))


def implementation_promotions(implementations: DataFrame, observations: DataFrame, attempts: DataFrame,
                              used: DataFrame, used_implementations: DataFrame, used_scripts: DataFrame,
                              strict_cross_task: bool = False) -> DataFrame:
    """J7 for implementations: explicit use of the policy, the implementation and its script.

    ``implementations``: implementation_id, policy_id, slug, script_name, status.
    ``observations``: implementation_id, task_fingerprint.
    """
    origins = observations.select("implementation_id", "task_fingerprint").distinct()
    owned = implementations.join(origins.select("implementation_id").distinct(), "implementation_id", "left_semi")
    passing = attempts.filter("verifier_passed").select(
        "attempt_id", T.task_fingerprint(F.col("task_name")).alias("task_fingerprint"))
    direct = used_implementations.distinct().join(
        owned, F.col("name") == F.col("implementation_id")).drop("name")
    names = F.array_distinct(F.array("policy_id", "slug"))
    named = direct.withColumn("name", F.explode(names)).join(used.distinct(), ["attempt_id", "name"], "left_semi")
    scripts = used_scripts.distinct().withColumnRenamed("name", "script_name")
    without = named.filter(F.col("script_name").isNull())
    hits = named.join(scripts, ["attempt_id", "script_name"], "left_semi").unionByName(without).join(passing, "attempt_id")
    if strict_cross_task:
        hits = hits.join(origins, ["implementation_id", "task_fingerprint"], "left_anti")
    evidence = hits.groupBy("implementation_id").agg(
        F.count_distinct("task_fingerprint", "attempt_id").alias("evidence"))
    n = F.coalesce("evidence", F.lit(0))
    return implementations.join(evidence, "implementation_id", "left").select(
        "implementation_id", "policy_id", F.when(n > 0, "active").otherwise(F.col("status")).alias("status"),
        n.alias("evidence"))


# --- near-duplicate contracts -------------------------------------------------------------

def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Walk one bounded block against the slots it touches.

    Rows: kind 'slot' (current occupants, with slot number) then kind 'new' in order.
    """
    slots = [
        {"no": int(r.slot), "row": r, "tokens": set(r.tokens)}
        for r in pdf[pdf["kind"] == "slot"].sort_values("slot").itertuples()
    ]
    next_slot = int(pdf["next_slot"].max())
    for r in pdf[pdf["kind"] == "new"].sort_values("pos").itertuples():
        mine = set(r.tokens)
        for s in slots:
            smaller = max(1, min(len(mine), len(s["tokens"])))
            if r.trigger == s["row"].trigger or len(mine & s["tokens"]) / smaller >= X.NEAR_DUPLICATE_OVERLAP:
                if (r.active, r.support) > (s["row"].active, s["row"].support):
                    s["row"], s["tokens"] = r, mine
                break
        else:
            slots.append({"no": next_slot, "row": r, "tokens": mine})
            next_slot += 1
    return pd.DataFrame([{
        "family": s["row"].family, "policy_id": s["row"].policy_id, "pos": s["row"].pos,
        "trigger": s["row"].trigger, "active": s["row"].active, "support": s["row"].support,
        "tokens": list(s["row"].tokens), "slot": s["no"]} for s in slots]).astype(
        {c: object for c in ("family", "policy_id", "trigger")})


SLOT_SCHEMA = ("family string, policy_id string, pos long, trigger string, active boolean, "
               "support long, tokens array<string>, slot long")


def compact_policies(policies: DataFrame) -> DataFrame:
    """One contract per reusable rule, in registry order.

    ``policies``: family, policy_id, pos (1-based order in the family), trigger, active,
    support, tokens. A policy that repeats the trigger or enough tokens of an earlier slot
    takes over the slot if it is better supported, else it is dropped. The rule is
    sequential, so it runs in rounds of one bounded block per family; the slots a block can
    touch are found by joins on the trigger and on rare tokens.
    """
    data = policies.filter(F.size("tokens") > 0).withColumn("trigger", F.lower("trigger")).withColumn(
        "block", F.floor((F.col("pos") - 1) / BLOCK_ROWS))
    data = cut_lineage(data.select("family", "policy_id", F.col("pos").cast("long").alias("pos"), "trigger", "active",
                                   F.col("support").cast("long").alias("support"), "tokens", "block"))
    last = data.agg(F.max("block")).first()[0]
    slots = None
    for block in range(0, int(last) + 1 if last is not None else 0):
        new = data.filter(F.col("block") == block).drop("block").withColumn("slot", F.lit(None).cast("long")) \
            .withColumn("kind", F.lit("new"))
        if slots is None:
            rows = new.withColumn("next_slot", F.lit(0).cast("long"))
            slots = rows.groupBy("family").applyInPandas(_choose, SLOT_SCHEMA)
        else:
            touched = _touched(new, slots)
            ends = slots.groupBy("family").agg((F.max("slot") + 1).alias("next_slot"))
            rows = new.unionByName(slots.join(touched, ["family", "slot"], "left_semi").withColumn(
                "kind", F.lit("slot"))).join(ends, "family", "left").withColumn(
                "next_slot", F.coalesce("next_slot", F.lit(0).cast("long")))
            busy = new.select("family").distinct()
            changed = rows.join(busy, "family", "left_semi").groupBy("family").applyInPandas(_choose, SLOT_SCHEMA)
            rest = slots.join(touched, ["family", "slot"], "left_anti")
            slots = changed.unionByName(rest)
        if int(last) > 0:
            slots = cut_lineage(slots)
    if slots is None:
        return data.withColumn("slot", F.lit(0).cast("long")).select("family", "policy_id", "slot")
    return slots.select("family", "policy_id", "slot")


def _touched(new: DataFrame, slots: DataFrame) -> DataFrame:
    """Slots that some policy of the block repeats; others can not change in this round.

    Chains count: a slot may be taken over by a block member whose tokens then attract
    another one, but that member is part of the block itself.
    """
    by_trigger = slots.join(new.select("family", "trigger").distinct(), ["family", "trigger"], "left_semi").select(
        "family", "slot")
    # Overlap is measured on the smaller set: probe with each side's rare tokens.
    need = F.greatest(F.lit(1), F.ceil(F.size("tokens") * X.NEAR_DUPLICATE_OVERLAP - 1e-9)).cast("int")
    slot_tokens = slots.select("family", "slot", F.explode("tokens").alias("token"))
    new_tokens = new.select("family", "pos", F.explode("tokens").alias("token"))
    freq = slot_tokens.unionByName(new_tokens, allowMissingColumns=True).groupBy("token").agg(
        F.count(F.lit(1)).alias("df"))
    rare_new = rarest_tokens(new.select("family", "pos", "tokens"), ["family", "pos"], need, freq)
    rare_slot = rarest_tokens(slots.select("family", "slot", "tokens"), ["family", "slot"], need, freq)
    a = slot_tokens.join(rare_new.select("family", "token").distinct(), ["family", "token"], "left_semi").select("family", "slot")
    b = rare_slot.join(new_tokens.select("family", "token").distinct(), ["family", "token"], "left_semi").select("family", "slot")
    return by_trigger.unionByName(a).unionByName(b).distinct()


# --- counters and versions ----------------------------------------------------------------

def status_counts(policies: DataFrame, keys: list[str]) -> DataFrame:
    """Policies per batch by status."""
    return policies.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("policies"),
        F.count_if(F.col("status") == "experimental").alias("experimental_policies"),
        F.count_if(F.col("status") == "active").alias("active_policies"))


def document_quality(documents: DataFrame, text: str = "text") -> DataFrame:
    """Words, non-empty lines, repeated lines and policy links per document."""
    from ..functions.lists import extract_all, strip
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), strip), lambda l: F.length(l) > 0)
    return documents.select(
        *[c for c in documents.columns if c != text],
        F.size(extract_all(F.col(text), r"(?U)\S+")).alias("word_count"),
        F.size(lines).alias("nonempty_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("duplicate_nonempty_lines"),
        F.size(extract_all(F.col(text), r"\]\((references/policies/[^)#]+\.md)\)")).alias("policy_links"))


def version_number(version):
    return F.regexp_extract(version, r"^v(\d+)$", 1).try_cast("int")


def first_versions(policy_versions: DataFrame) -> DataFrame:
    """First version, in numeric order, that lists a policy."""
    n = version_number(F.col("version"))
    return policy_versions.withColumn("_n", n).filter(F.col("_n").isNotNull()).groupBy("policy_id").agg(
        F.min_by("version", "_n").alias("first_version"), F.min("_n").alias("first_number"))


def epoch_versions(history: DataFrame, keys: list[str]) -> DataFrame:
    """Version in force after the last batch of each epoch."""
    version = F.coalesce(F.nullif(F.col("promoted_version"), F.lit("")), F.col("snapshot_version"))
    return history.groupBy(*keys, "epoch_index").agg(F.max_by(version, "batch_index").alias("version"))


def unchanged_versions(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions whose runtime files equal their parent's.

    ``files``: version, path, sha. ``versions``: version, parent_version. Order-free sums of
    row hashes stand for the file sets, so no set is collected.
    """
    h = F.xxhash64("path", "sha")
    digest = files.distinct().groupBy("version").agg(
        F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))
    own = versions.join(digest, "version", "left").select(
        "version", "parent_version", F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "s", "x")]).alias("d"))
    parent = digest.select(F.col("version").alias("parent_version"),
                           F.struct("n", "s", "x").alias("pd"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("s"),
                    F.lit(0).cast("long").alias("x"))
    return own.join(parent, "parent_version", "left").select(
        "version", "parent_version",
        ((F.col("d.n") == F.coalesce("pd.n", zero["n"])) & (F.col("d.s") == F.coalesce("pd.s", zero["s"]))
         & (F.col("d.x") == F.coalesce("pd.x", zero["x"]))).alias("workflow_only"))


def rank_policies(policies: DataFrame, limit: int) -> DataFrame:
    """K1: active first, then id; one row per policy, first ``limit`` ranks."""
    unique = first_rows(policies, ["policy_id"], [F.col("status") != "active"])
    top = unique.orderBy(F.col("status") != "active", "policy_id").limit(limit)
    w = Window.orderBy(F.col("status") != "active", "policy_id")     # at most ``limit`` rows
    return top.withColumn("candidate_rank", F.row_number().over(w))


def workflow_estimate(updates: DataFrame, versions: DataFrame, files: DataFrame) -> DataFrame:
    """Audit counters: workflow update records and versions that changed nothing else."""
    same = unchanged_versions(files, versions.join(updates.select("version").distinct(), "version", "left_semi"))
    rows = updates.select(F.lit("update").alias("what")).unionByName(same.filter("workflow_only").select(F.lit("same").alias("what")))
    return rows.agg(F.count_if(F.col("what") == "update").alias("workflow_update_records"),
                    F.count_if(F.col("what") == "same").alias("workflow_only_version_estimate"))
