"""Behavioural audit of policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..session import cut_lineage
from .overlap import candidate_pairs


def _shape_matches(commands: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(policy_id, kind) and (kind, sets, signal): which kinds of policies occur in which kinds of attempts.

    Policies with the same shapes are one kind, attempts with the same words another, so what is compared
    grows with the distinct shapes and word sets. ``seen``: sets, the word sets of an attempt.
    """
    wanted = commands.select("policy_id", "pos", F.array_sort(T.distinctive_tokens(F.col("command_shape"))).alias("tokens"))
    wanted = wanted.filter((F.size("tokens") >= X.AUDIT_MIN_SHARED) & F.col("policy_id").isNotNull() & F.col("pos").isNotNull())
    # a policy has a handful of shapes
    kinds = cut_lineage(wanted.groupBy("policy_id").agg(F.array_sort(F.collect_set(F.struct("pos", "tokens"))).alias("kind")))
    shapes = kinds.select("kind").distinct().select("kind", F.inline("kind"))
    words = seen.select("sets").distinct().select("sets", F.explode("sets").alias("words"))
    left, right = shapes.select("tokens").distinct(), words.select("words").distinct()
    need = F.greatest(F.lit(X.AUDIT_MIN_SHARED), F.ceil(F.size("tokens") * X.AUDIT_MIN_OVERLAP - 1e-9)).cast("int")
    pairs = candidate_pairs(left.select("tokens", F.col("tokens").alias("shape")), ["shape"], need,
                            right.select("words", F.explode("words").alias("token")), ["words"])
    shared = F.size(F.array_intersect("shape", "words"))
    checked = pairs.withColumn("shared", shared).withColumn("overlap", F.col("shared") / F.size("shape"))
    hits = checked.filter((F.col("shared") >= X.AUDIT_MIN_SHARED) & (F.col("overlap") >= X.AUDIT_MIN_OVERLAP)).select(
        F.col("shape").alias("tokens"), "words", F.concat(F.lit("command_shape_overlap_"), F.format_string("%.2f", F.bround("overlap", 2))).alias("signal"))
    found = hits.join(words, "words").join(shapes, "tokens")
    return kinds, found.groupBy("kind", "sets").agg(F.min_by("signal", F.struct("pos", "signal")).alias("signal"))


def occurrences(policies: DataFrame, commands: DataFrame, attempts: DataFrame, used: DataFrame, summed: bool = False) -> DataFrame:
    """Attempts in which a policy occurs, by explicit use or shared distinctive tokens.

    ``policies``: policy_id, slug. ``commands``: policy_id, pos, command_shape. ``attempts``:
    attempt_id, text. ``used``: attempt_id, name. The token rule needs three shared tokens and
    30 % of the distinctive ones; candidates come from rare tokens only. Explicit use comes first, then the
    policy's earliest shape.

    Rows: policy_id, attempt_id, signal. With ``summed``: policy_id, signal, attempts, first_attempt and
    last_attempt, for which policies do not meet single attempts.
    """
    names = policies.select("policy_id", F.explode(F.array_distinct(F.array(
        F.lower("policy_id"), F.lower("slug")))).alias("name"))
    explicit = used.select("attempt_id", F.lower("name").alias("name")).distinct().join(
        names, "name").select("policy_id", "attempt_id").distinct()
    words = F.array_sort(T.audit_tokens(F.col("text")))
    seen = attempts.where("attempt_id is not null").select("attempt_id", words.alias("words")).groupBy("attempt_id").agg(
        F.array_sort(F.collect_set("words")).alias("sets"))
    if not summed:
        kinds, found = _shape_matches(commands, seen)
        by_shape = found.join(kinds, "kind").join(seen, "sets").select("policy_id", "attempt_id", "signal").join(
            explicit, ["policy_id", "attempt_id"], "left_anti")
        return explicit.select("policy_id", "attempt_id", F.lit("explicit_policy_use").alias("signal")).unionByName(by_shape)

    seen, explicit = cut_lineage(seen), cut_lineage(explicit)
    kinds, found = _shape_matches(commands, seen)
    groups = seen.groupBy("sets").agg(F.count(F.lit(1)).alias("n"), F.min("attempt_id").alias("first"), F.max("attempt_id").alias("last"))
    found = cut_lineage(found.join(groups, "sets"))
    total = lambda d, *keys: d.groupBy(*keys, "signal").agg(
        F.sum("n").alias("attempts"), F.min("first").alias("first_attempt"), F.max("last").alias("last_attempt"))
    # policies with a shape in an attempt that uses them by name do without those attempts
    named = cut_lineage(explicit.join(kinds, "policy_id").join(seen, "attempt_id").join(found, ["kind", "sets"]))
    per_group = named.groupBy("policy_id", "sets").agg(F.count(F.lit(1)).alias("without"))
    # the ends of a group are looked for again where such an attempt is one: at most twice for each group and name
    ends = named.where("attempt_id = first or attempt_id = last").select("policy_id", "sets").distinct()
    ends = ends.join(seen, "sets").join(explicit, ["policy_id", "attempt_id"], "left_anti").groupBy("policy_id", "sets").agg(
        F.min("attempt_id").alias("_first"), F.max("attempt_id").alias("_last"))
    some = named.select("policy_id", "kind").distinct().join(found, "kind").join(per_group, ["policy_id", "sets"], "left").join(
        ends, ["policy_id", "sets"], "left")
    some = some.withColumn("n", F.col("n") - F.coalesce("without", F.lit(0))).where("n > 0").select(
        "policy_id", "signal", "n", F.coalesce("_first", "first").alias("first"), F.coalesce("_last", "last").alias("last"))
    others = kinds.join(named.select("policy_id").distinct(), "policy_id", "left_anti").join(total(found, "kind"), "kind").drop("kind")
    by_name = explicit.groupBy("policy_id").agg(F.count(F.lit(1)).alias("attempts"), F.min("attempt_id").alias("first_attempt"), F.max("attempt_id").alias("last_attempt"))
    return by_name.select("policy_id", F.lit("explicit_policy_use").alias("signal"), "attempts", "first_attempt", "last_attempt").unionByName(
        total(some, "policy_id")).unionByName(others.select("policy_id", "signal", "attempts", "first_attempt", "last_attempt"))


def audit_rows(policies: DataFrame, origins: DataFrame, attempts: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per policy with occurrence, success and retry statistics and a label.

    ``policies``: policy_id, status, first_number (nullable), has_substeps. ``origins``:
    policy_id, task_fingerprint. ``attempts``: attempt_id, task_name, attempt_number, success,
    snapshot_number. Two slices matter per policy: earlier attempts of its origin tasks (an
    equi-join, J12) and all attempts from its first version on. The second slice is summed per
    (version, task) once and reused by every policy, so policies never meet single attempts.
    """
    a = attempts.withColumn("task_fingerprint", T.task_fingerprint(F.col("task_name")))
    o = origins.select("policy_id", "task_fingerprint").distinct().join(
        policies.select("policy_id", "first_number"), "policy_id")
    before = F.col("first_number").isNull() | (F.col("snapshot_number") < F.col("first_number"))
    rows = a.join(o, "task_fingerprint").filter(before).join(
        hits, ["policy_id", "attempt_id"], "left").withColumn("occurs", F.col("signal").isNotNull())
    later = (F.col("attempt_number") > 1) & F.col("occurs") & F.col("success")
    per_task = rows.groupBy("policy_id", "task_name").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if((F.col("attempt_number") == 1) & F.col("occurs")).alias("first_occurs"),
        F.count_if(later).alias("later_success"),
        F.max(F.when(later, F.col("attempt_number"))).alias("_last_later"),
        F.min(F.when(~F.col("success"), F.col("attempt_number"))).alias("_first_failure"),
        F.max_by("success", F.struct("attempt_number", "attempt_id")).alias("_final"),
        F.greatest(F.max("attempt_number") - 1, F.lit(0)).alias("_retries"))
    origin = per_task.groupBy("policy_id").agg(
        F.sum("attempts").alias("origin_attempts"), F.sum("first_occurs").alias("first_attempt_occurrence"),
        F.sum("later_success").alias("later_successful_occurrence"),
        F.count_if(F.col("_last_later") > F.col("_first_failure")).alias("improved_tasks"),
        F.count_if("_final").alias("origin_final_successes"), F.avg("_retries").alias("_origin_mean"))
    # Attempts from a version on, per task: last attempt and retries over a suffix of versions.
    firsts = policies.filter(F.col("first_number").isNotNull()).select("first_number").distinct()
    per_version = a.filter(F.col("snapshot_number").isNotNull()).groupBy("snapshot_number", "task_name").agg(
        F.max(F.struct("attempt_number", "attempt_id", "success")).alias("_last"))
    # A task counts, with its last attempt so far, for every first version in (previous, current].
    # Each such range becomes an increment at its start and a decrement behind its end.
    down = Window.partitionBy("task_name").orderBy(F.desc("snapshot_number"))
    ranges = per_version.select(
        F.max("_last").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("_best"),
        (F.coalesce(F.lead("snapshot_number").over(down), F.lit(-1)) + 1).alias("start"),
        (F.col("snapshot_number") + 1).alias("stop"))
    value = F.struct(F.lit(1).alias("n"), F.col("_best.success").cast("int").alias("ok"),
                     F.greatest(F.col("_best.attempt_number") - 1, F.lit(0)).alias("retries"))
    marks = ranges.select(F.explode(F.array(
        F.struct(F.col("start").alias("at"), F.lit(1).alias("sign"), value.alias("v")),
        F.struct(F.col("stop").alias("at"), F.lit(-1).alias("sign"), value.alias("v")))).alias("m"))
    steps = marks.groupBy(F.col("m.at").alias("first_number")).agg(*[
        F.sum(F.col("m.sign") * F.col(f"m.v.{c}")).alias(c) for c in ("n", "ok", "retries")])
    line = Window.orderBy("first_number").rowsBetween(Window.unboundedPreceding, 0)   # one row per version
    subsequent = firsts.join(steps, "first_number", "full").select(
        "first_number", *[F.coalesce(F.sum(c).over(line), F.lit(0)).alias(c) for c in ("n", "ok", "retries")]
    ).select("first_number", F.col("n").alias("subsequent_tasks"), F.col("ok").alias("subsequent_final_successes"),
             F.try_divide("retries", "n").alias("_sub_mean"))
    hit_rows = hits.join(a.drop("task_fingerprint"), "attempt_id").join(
        policies.select("policy_id", "first_number"), "policy_id")
    adopted = (F.col("attempt_number") == 1) & (F.col("snapshot_number") >= F.col("first_number"))
    seen = hit_rows.groupBy("policy_id").agg(
        F.count_distinct("task_name").alias("observed_tasks"),
        F.count_distinct(F.when(adopted, F.col("task_name"))).alias("adopted_tasks"),
        F.bool_or(F.col("signal") == "explicit_policy_use").alias("_explicit"))
    has_origin = origins.join(a.select("task_fingerprint").distinct(), "task_fingerprint", "left_semi").select(
        "policy_id").distinct().withColumn("_has_origin", F.lit(True))
    n = lambda c: F.coalesce(c, F.lit(0))
    no = F.lit(False)
    matchable = F.coalesce("has_substeps", no) | F.coalesce("_explicit", no)
    unknown = ~F.coalesce("_has_origin", no) | F.col("first_number").isNull() | ~matchable
    induced = (n("later_successful_occurrence") > 0) & (n("improved_tasks") > 0) & (n("first_attempt_occurrence") == 0)
    spontaneous = (n("first_attempt_occurrence") > 0) & (n("later_successful_occurrence") == 0)
    label = F.when(unknown, "ambiguous").when(induced, "exploration-induced").when(
        spontaneous, "spontaneous").otherwise("ambiguous")
    confidence = F.when(unknown, "low").when(induced, "high").when(spontaneous, "medium").otherwise("low")
    d = policies.join(origin, "policy_id", "left").join(seen, "policy_id", "left").join(
        has_origin, "policy_id", "left").join(subsequent, "first_number", "left")
    return d.select(
        "policy_id", F.col("status").alias("policy_status"), "first_number", n("observed_tasks").alias("observed_tasks"),
        n("subsequent_tasks").alias("subsequent_tasks"), n("adopted_tasks").alias("adopted_tasks"),
        n("first_attempt_occurrence").alias("first_attempt_occurrence"),
        n("later_successful_occurrence").alias("later_successful_occurrence"),
        n("origin_attempts").alias("origin_attempts"), n("origin_final_successes").alias("origin_final_successes"),
        n("subsequent_final_successes").alias("subsequent_final_successes"),
        F.bround("_origin_mean", 3).alias("origin_retry_mean"), F.bround("_sub_mean", 3).alias("subsequent_retry_mean"),
        F.bround(F.col("_sub_mean") - F.col("_origin_mean"), 3).alias("retry_delta"),
        label.alias("heuristic_label"), confidence.alias("label_confidence"))


def audit_summary(rows: DataFrame) -> DataFrame:
    """The four labels, empty ones included."""
    spark = rows.sparkSession
    labels = spark.createDataFrame([(x,) for x in X.AUDIT_LABELS], "heuristic_label string")
    agg = rows.groupBy("heuristic_label").agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.avg((F.col("adopted_tasks") > 0).cast("int")), 3).alias("adoption_rate"),
        F.bround(F.try_divide(F.sum("subsequent_final_successes"), F.sum("subsequent_tasks")), 3).alias("subsequent_success_rate"),
        F.bround(F.avg("retry_delta"), 3).alias("retry_delta_mean"))
    return F.broadcast(labels).join(agg, "heuristic_label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
