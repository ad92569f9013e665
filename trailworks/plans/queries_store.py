"""Store, policy, metric, split and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as AU
from ..operators import memory as M
from ..operators import metrics as ME
from ..operators import policies as P
from ..operators import retry as R
from ..operators import splits as SP
from ..operators import trajectory as TR
from ..session import cut_lineage, shared_folder
from ..streaming import jobs as ST
from ..streaming.store import read_store
from . import evidence as EV
from . import views as V
from .catalog import query
from .queries_trajectory import CANDIDATES_SQL, LINKS_SQL, REFLECTION_SQL, W, all_candidates
from .views import table

A = V.ATT

# --- memory store (J4-J6, J8, A4, C5, C6, R4, R5, P29) --------------------------------------

# Memories have no quoted paths or secrets besides the one path, so redaction is one replacement.
MEM_SQL = V.merge_ctes(REFLECTION_SQL, f"""
mem0 AS (SELECT *, observable AS observation, corrective AS lesson, regexp_replace(root_cause, '(^|\\s)/(?:[^\\s]+/)+[^\\s]+', '\\1[redacted path]', 'g') AS rationale,
   CASE retry_outcome WHEN 'success' THEN 'true' WHEN 'failure' THEN 'false' ELSE 'null' END AS passed FROM refl),
mem AS (SELECT *, 'memory-' || left(sha256('{{"attempt_number":' || attempt_number || ',"candidate_kind":null,"intent":null,"lesson":"' || lesson || '","rationale":"' || rationale || '","retry_outcome":"' || retry_outcome
   || '","retry_transition":{{"from_attempt":' || attempt_number || ',"retry_verifier_passed":' || passed || ',"to_attempt":' || (attempt_number + 1) || '}},"task_family":"' || task_family || '","task_name":"' || task_name || '"}}'), 20) AS memory_id FROM mem0)""")


def _memories(spark, sf):
    return M.memory_records(R.retry_links(V.attempts(spark, sf)))


@query("memory_records", f"WITH {MEM_SQL} SELECT memory_id, {A}, observation, lesson, rationale, retry_outcome FROM mem")
def memory_records(spark, sf):
    return _memories(spark, sf).select("memory_id", *TR.ATTEMPT, "observation", "lesson", "rationale", "retry_outcome")


PC_SQL = V.merge_ctes(CANDIDATES_SQL, """
pc AS (SELECT *, 'memory-' || left(sha256('{"attempt_number":null,"candidate_kind":"recovery_candidate","intent":"' || intent || '","lesson":"' || resolution || '","rationale":"' || obstacle
   || '","retry_outcome":null,"retry_transition":{},"task_family":"' || task_family || '","task_name":"' || task_name || '"}'), 20) AS memory_id FROM span_candidates)""")


@query("policy_candidate_records", f"WITH {PC_SQL} SELECT memory_id, candidate_id, task_name, intent, obstacle, resolution AS lesson, evidence_label AS outcome FROM pc")
def policy_candidate_records(spark, sf):
    d = M.policy_candidate_records(TR.span_candidates(V.calls(spark, sf), V.attempts(spark, sf)))
    return d.select("memory_id", "candidate_id", "task_name", "intent", "obstacle", "lesson", "outcome")


def _store_and_batch(spark, sf):
    """Store: users of all but the last week seen, batch: users of the last two weeks; ids repeat."""
    d = V._event_base(spark, sf).groupBy("task_name", "attempt_number").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    d = d.withColumn("memory_id", F.concat(F.lit("m-"), F.sha2("task_name", 256).substr(1, 20)))
    old = M.last_per_id(d.filter("attempt_number <= 3").withColumn("representation", F.when(F.col("n") > 14, M.MEMORY_PROMOTED).otherwise("memory")), "attempt_number")
    new = M.last_per_id(d.filter("attempt_number >= 4").withColumn("representation", F.lit("memory")), "attempt_number")
    return old, new


MERGE_SQL = V.EVENTS_SQL + """,
d AS (SELECT task_name, attempt_number, count(*) AS n, max(value) AS top, 'm-' || left(sha256(task_name), 20) AS memory_id FROM ev GROUP BY 1, 2),
o AS (SELECT *, CASE WHEN n > 14 THEN 'memory_residual' ELSE 'memory' END AS representation FROM d WHERE attempt_number <= 3 QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY attempt_number DESC) = 1),
n AS (SELECT *, 'memory' AS representation FROM d WHERE attempt_number >= 4 QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY attempt_number DESC) = 1),
merged AS (SELECT coalesce(n.memory_id, o.memory_id) AS memory_id, coalesce(n.task_name, o.task_name) AS task_name, coalesce(n.attempt_number, o.attempt_number) AS attempt_number, coalesce(n.n, o.n) AS n, coalesce(n.top, o.top) AS top,
  CASE WHEN o.representation = 'memory_residual' THEN 'memory_residual' ELSE coalesce(n.representation, o.representation) END AS representation FROM o FULL JOIN n ON o.memory_id = n.memory_id)"""


@query("store_merge", f"WITH {MERGE_SQL} SELECT * FROM merged")
def store_merge(spark, sf):
    return M.merge_store(*_store_and_batch(spark, sf), M.MEMORY_PROMOTED)


@query("store_counts", f"""WITH {MERGE_SQL} SELECT (SELECT count(*) FROM merged) AS total, (SELECT count(*) FROM merged WHERE representation = 'memory') AS unpromoted, (SELECT count(*) FROM merged WHERE representation = 'memory_residual') AS skill_factored,
  count(*) AS policy_candidates, count(*) AS pending_policy_candidates, 0::BIGINT AS compiled_policy_candidates FROM n""")
def store_counts(spark, sf):
    old, new = _store_and_batch(spark, sf)
    return M.store_counts(M.merge_store(old, new, M.MEMORY_PROMOTED), new.withColumn("representation", F.lit("candidate")))


def _compiled(spark, sf):
    d = table(spark, sf, "orders").select(
        F.concat(F.lit("mem-"), F.col("o_orderkey").cast("string")).alias("memory_id"), F.concat(F.lit("cand-"), F.col("o_custkey").cast("string")).alias("candidate_id"), "o_orderstatus", "o_orderpriority")
    mem = d.filter("o_orderstatus = 'F'").select("memory_id", "candidate_id", F.lit("memory").alias("representation"))
    cand = d.filter("o_orderstatus <> 'F'").select("memory_id", "candidate_id", F.lit("candidate").alias("representation"))
    ids = d.filter("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'").select(F.col("memory_id").alias("id")).unionByName(
        d.filter("o_orderstatus = 'P' and o_orderpriority = '5-LOW'").select(F.col("candidate_id").alias("id")))
    return M.mark_compiled(mem, cand, ids)


COMPILED_SQL = """d AS (SELECT 'mem-' || o_orderkey AS memory_id, 'cand-' || o_custkey AS candidate_id, * FROM orders),
ids AS (SELECT memory_id AS id FROM d WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' UNION SELECT candidate_id FROM d WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'),
c AS (SELECT memory_id, candidate_id, memory_id IN (SELECT id FROM ids) OR candidate_id IN (SELECT id FROM ids) AS hit FROM d WHERE o_orderstatus <> 'F'),
src AS (SELECT id FROM ids UNION SELECT candidate_id FROM c WHERE hit)"""


@query("compiled_memories", f"""WITH {COMPILED_SQL} SELECT memory_id, CASE WHEN memory_id IN (SELECT id FROM ids) OR candidate_id IN (SELECT id FROM src) THEN 'memory_residual' ELSE 'memory' END AS representation FROM d WHERE o_orderstatus = 'F'""")
def compiled_memories(spark, sf):
    return _compiled(spark, sf)[0].select("memory_id", "representation")


@query("compiled_candidates", f"WITH {COMPILED_SQL} SELECT memory_id, CASE WHEN hit THEN 'skill_factored' ELSE 'candidate' END AS representation FROM c")
def compiled_candidates(spark, sf):
    return _compiled(spark, sf)[1].select("memory_id", "representation")


@query("prior_candidates", """SELECT 'cand-' || o_orderkey AS candidate_id, 'now' AS origin FROM orders WHERE o_orderstatus <> 'P'
 UNION ALL SELECT DISTINCT 'cand-' || l_orderkey, 'prior' FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def prior_candidates(spark, sf):
    key = lambda c: F.concat(F.lit("cand-"), F.col(c).cast("string")).alias("candidate_id")
    now = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(key("o_orderkey"), F.lit("now").alias("origin"))
    prior = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(key("l_orderkey"), F.lit("prior").alias("origin")).distinct()
    return M.add_prior(now, prior)


@query("pending_candidates", f"""WITH {PC_SQL} SELECT memory_id AS candidate_id, task_name, intent, obstacle, resolution, evidence_label FROM pc WHERE evidence_label <> 'tool_recovery'""")
def pending_candidates(spark, sf):
    d = M.policy_candidate_records(TR.span_candidates(V.calls(spark, sf), V.attempts(spark, sf)))
    d = d.withColumn("representation", F.when(F.col("outcome") == "tool_recovery", M.CANDIDATE_PROMOTED).otherwise("candidate"))
    return M.pending_candidates(d).select("candidate_id", "task_name", "intent", "obstacle", "resolution", "evidence_label")


@query("public_memories", f"""WITH {MEM_SQL} SELECT memory_id, observation, CASE WHEN retry_outcome = 'success' THEN 'The recurring procedure from this episode was compiled into the family skill. Use this memory only for its instance context, observation, rationale, and outcome.' ELSE lesson END AS lesson FROM mem""")
def public_memories(spark, sf):
    d = _memories(spark, sf).withColumn("representation", F.when(F.col("verified_by_retry"), M.MEMORY_PROMOTED).otherwise("memory"))
    return M.public_view(d).select("memory_id", "observation", "lesson")


@query("store_migration", f"""WITH {LINKS_SQL}, r AS (SELECT *, n_errors > 3 AS promoted FROM attempts)
 SELECT CASE WHEN promoted THEN 'skill_factored' ELSE 'candidate' END AS representation, count(*) AS candidates, count(*) FILTER (reflection <> '') AS memories FROM r GROUP BY 1""")
def store_migration(spark, sf):
    d = V.attempts(spark, sf).select(
        "task_name", F.concat("task_name", F.when(F.length("reflection") > 0, ":reflection-1").otherwise(":candidate-1")).alias("candidate_id"),
        F.lit(None).cast("array<string>").alias("reflection_files"), F.lit(None).cast("string").alias("evidence_source"),
        F.when(F.col("n_errors") > 3, M.MEMORY_PROMOTED).otherwise("memory").alias("representation"))
    mem, cand = M.migrate_v1(d)
    to = F.when(F.col("representation") == M.MEMORY_PROMOTED, M.CANDIDATE_PROMOTED).otherwise("candidate")
    return cand.groupBy("representation").agg(F.count(F.lit(1)).alias("candidates")).join(
        mem.groupBy(to.alias("representation")).agg(F.count(F.lit(1)).alias("memories")), "representation", "left").select(
        "representation", "candidates", F.coalesce("memories", F.lit(0)).alias("memories"))


def _lineage(spark, sf):
    """Published lineage: every candidate of a passing attempt, its resolution kept only for odd weeks."""
    c = cut_lineage(TR.span_candidates(V.calls(spark, sf), V.attempts(spark, sf)))
    rec = M.policy_candidate_records(c)
    ev = c.filter("evidence_label = 'verified_success'").select(
        T.task_fingerprint(F.col("task_name")).alias("task_fingerprint"), F.col("evidence_source").alias("source"), F.col("evidence_label").alias("label"), "retry_outcome",
        F.when(F.col("attempt_number") % 2 == 1, F.col("resolution")).otherwise("rewritten").alias("resolution"))
    return rec, ev


LINEAGE_SQL = V.merge_ctes(PC_SQL, """
lin AS (SELECT DISTINCT task_name, CASE WHEN attempt_number % 2 = 1 THEN resolution ELSE 'rewritten' END AS resolution FROM span_candidates WHERE evidence_label = 'verified_success'),
lm AS (SELECT DISTINCT memory_id, CASE WHEN EXISTS (SELECT 1 FROM lin l WHERE l.task_name = pc.task_name AND l.resolution = pc.resolution) THEN 'exact_resolution' ELSE 'trajectory_provenance' END AS mode
  FROM pc WHERE evidence_label = 'verified_success')""")


@query("lineage_matches", f"WITH {LINEAGE_SQL} SELECT * FROM lm")
def lineage_matches(spark, sf):
    rec, ev = _lineage(spark, sf)
    return M.lineage_matches(rec.withColumnRenamed("evidence_source", "source"), ev)


BACKFILL_SQL = V.merge_ctes(LINEAGE_SQL.split("\nlm AS (")[0].rstrip().rstrip(","), """
last AS (SELECT * FROM pc QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY candidate_id DESC) = 1),
lm AS (SELECT memory_id, CASE WHEN EXISTS (SELECT 1 FROM lin l WHERE l.task_name = last.task_name AND l.resolution = last.resolution) THEN 'exact_resolution' ELSE 'trajectory_provenance' END AS mode
  FROM last WHERE evidence_label = 'verified_success' AND task_name IN (SELECT task_name FROM lin))""")


@query("store_backfill", f"""WITH {BACKFILL_SQL} SELECT (SELECT count(*) FROM lm WHERE mode = 'exact_resolution') AS exact_resolution_candidates, (SELECT count(*) FROM lm WHERE mode <> 'exact_resolution') AS trajectory_provenance_candidates,
 (SELECT count(DISTINCT memory_id) FROM pc) AS policy_candidates""")
def store_backfill(spark, sf):
    rec, ev = _lineage(spark, sf)
    rec = M.last_per_id(rec, "candidate_id")
    return M.backfill(rec, _memories(spark, sf).select("memory_id", "candidate_id", "representation"), ev)[2].select(
        "exact_resolution_candidates", "trajectory_provenance_candidates", "policy_candidates")


@query("evidence_clusters")
def evidence_clusters(spark, sf):
    """Main path end to end: steps to publishable clusters, with hashed text vectors."""
    clusters, _ = EV.cluster(all_candidates(spark, sf))
    return clusters.select("capability_id", "task_family", "candidate_kind", "members", "support", "qualifying_tasks", "verified")


# --- policies (C4, J7, J9, J11, A12, A13, A15, A17, A18, W7, W8, K1) ------------------------

def _policies(spark, sf):
    """Parts as policies: id, slug, trigger, status and first version from part fields."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.concat(F.lit("policy-"), k.cast("string")).alias("policy_id"), F.concat(F.lit("rule-"), k.cast("string")).alias("slug"), F.col("p_brand").alias("family"),
        F.concat(F.lit("handle "), F.col("p_name"), F.lit(" of "), F.col("p_type")).alias("trigger"), F.when(F.col("p_size") > 40, "active").otherwise("experimental").alias("status"),
        F.concat(F.col("p_name"), F.lit(" rule")).alias("name"), F.concat(F.lit("keep "), F.lower("p_type"), F.lit(" sizes near "), (F.col("p_size") % 7).cast("string")).alias("purpose"),
        F.when(F.col("p_size") % 10 != 0, (F.col("p_size") % 5).cast("int")).alias("first_number"), (F.col("p_size") % 2 == 0).alias("has_substeps"), k.alias("p_partkey"), F.col("p_size").cast("long").alias("support"))


def _next_key(spark, sf, name, column):
    """One more than the largest key of a table: fixtures spread over the whole key range at any scale."""
    return (table(spark, sf, name).agg(F.max(column)).first()[0] or 0) + 1


def _observations(spark, sf):
    k = F.col("p_partkey")
    users = _next_key(spark, sf, "events", "user_id")
    task = lambda n: T.task_fingerprint(F.concat(F.lit("task-"), ((k * n + 3) % users).cast("string")))
    d = table(spark, sf, "part").select(F.concat(F.lit("policy-"), k.cast("string")).alias("policy_id"), F.explode(F.array(task(1), task(5))).alias("task_fingerprint"))
    return d


def _used(spark, sf):
    """What each step names: a policy by slug or, for errors, by id."""
    number = ((F.col("user_id") * 7 + F.col("k") * 13) % _next_key(spark, sf, "part", "p_partkey")).cast("string")
    return V._event_base(spark, sf).select(
        F.concat_ws(":", "task_name", F.col("attempt_number").cast("string")).alias("attempt_id"),
        F.concat(F.when(F.col("event_type") == "error", "policy-").otherwise("rule-"), number).alias("name"))


POL_SQL = V.merge_ctes(V.ATTEMPTS_SQL, """
pol AS (SELECT 'policy-' || p_partkey AS policy_id, 'rule-' || p_partkey AS slug, p_brand AS family, CASE WHEN p_size > 40 THEN 'active' ELSE 'experimental' END AS status,
  CASE WHEN p_size % 10 <> 0 THEN p_size % 5 END AS first_number, p_size % 2 = 0 AS has_substeps, p_partkey FROM part),
obs AS (SELECT DISTINCT 'policy-' || p_partkey AS policy_id, 'task-' || unnest([(p_partkey + 3) % (SELECT max(user_id) + 1 FROM events), (p_partkey * 5 + 3) % (SELECT max(user_id) + 1 FROM events)]) AS task_name FROM part),
used AS (SELECT DISTINCT task_name || ':' || attempt_number AS attempt_id, 'policy-' || ((user_id * 7 + k * 13) % (SELECT max(p_partkey) + 1 FROM part)) AS policy_id FROM ev),
hits AS (SELECT u.policy_id, a.* FROM used u JOIN pol USING (policy_id) JOIN attempts a USING (attempt_id))""")


@query("policy_promotions", f"""WITH {POL_SQL}, e AS (SELECT policy_id, count(DISTINCT attempt_id) AS evidence FROM hits h WHERE verifier_passed AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.policy_id = h.policy_id AND o.task_name = h.task_name) GROUP BY 1)
 SELECT policy_id, CASE WHEN coalesce(evidence, 0) > 0 THEN 'active' ELSE status END AS status, coalesce(evidence, 0) AS evidence, coalesce(evidence, 0) > 0 AND status <> 'active' AS promoted FROM pol LEFT JOIN e USING (policy_id)""")
def policy_promotions(spark, sf):
    return P.promotions(_policies(spark, sf), _observations(spark, sf), V.attempts(spark, sf), _used(spark, sf), strict_cross_task=True).drop("slug")


@query("open_promotions", f"""WITH {POL_SQL}, e AS (SELECT o.policy_id, count(*) AS own FROM obs o JOIN attempts a ON o.task_name = a.task_name AND verifier_passed GROUP BY 1)
 SELECT policy_id, (SELECT count(*) FROM attempts WHERE verifier_passed) - coalesce(own, 0) AS evidence FROM pol LEFT JOIN e USING (policy_id)""")
def open_promotions(spark, sf):
    return P.promotions(_policies(spark, sf), _observations(spark, sf), V.attempts(spark, sf), _used(spark, sf), strict_cross_task=True, require_policy_use=False).select("policy_id", "evidence")


@query("implementation_promotions", f"""WITH {POL_SQL}, e AS (SELECT h.policy_id, count(DISTINCT h.attempt_id) AS evidence FROM hits h WHERE verifier_passed GROUP BY 1)
 SELECT 'impl-' || policy_id AS implementation_id, CASE WHEN coalesce(evidence, 0) > 0 THEN 'active' ELSE 'experimental' END AS status, coalesce(evidence, 0) AS evidence FROM pol LEFT JOIN e USING (policy_id)""")
def implementation_promotions(spark, sf):
    pol, used = _policies(spark, sf), _used(spark, sf)
    impl = pol.select(F.concat(F.lit("impl-"), F.col("policy_id")).alias("implementation_id"), "policy_id", "slug",
                      F.when(F.col("support") > 25, F.concat("slug", F.lit(".py"))).alias("script_name"), F.lit("experimental").alias("status"))
    obs = _observations(spark, sf).select(F.concat(F.lit("impl-"), F.col("policy_id")).alias("implementation_id"), "task_fingerprint")
    by_id = used.select("attempt_id", F.concat(F.lit("policy-"), F.substring_index("name", "-", -1)).alias("name"))
    return P.implementation_promotions(impl, obs, V.attempts(spark, sf), used, by_id.select("attempt_id", F.concat(F.lit("impl-"), F.col("name")).alias("name")),
                                       by_id.select("attempt_id", F.concat(F.lit("rule-"), F.substring_index("name", "-", -1), F.lit(".py")).alias("name"))).select("implementation_id", "status", "evidence")


@query("registry_upsert", """SELECT coalesce(a.k, b.k) AS policy_id, coalesce(b.name, a.name) AS name, CASE WHEN a.k IS NULL THEN 'created' WHEN b.k IS NULL THEN 'kept' WHEN a.name <> b.name THEN 'updated' ELSE 'unchanged' END AS change,
  CASE WHEN a.k IS NULL THEN 'experimental' ELSE a.status END AS status
 FROM (SELECT p_partkey AS k, p_name AS name, CASE WHEN p_size > 40 THEN 'active' ELSE 'experimental' END AS status FROM part WHERE p_size > 10) a
 FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part WHERE p_size < 30) b ON a.k = b.k""")
def registry_upsert(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("policy_id"), F.col("p_name").alias("name"), F.lit("p").alias("purpose"), F.lit("t").alias("trigger"), F.array(F.lit("i")).alias("invariants"),
                                        F.array(F.lit("r")).alias("recovery"), F.col("p_name").alias("slug"), F.when(F.col("p_size") > 40, "active").otherwise("experimental").alias("status"), "p_size")
    new = d.filter("p_size < 30").withColumn("name", F.when(F.col("p_size") % 3 == 0, F.upper("name")).otherwise(F.col("name"))).drop("slug", "status", "p_size")
    return P.upsert_policies(d.filter("p_size > 10").drop("p_size"), new).select("policy_id", "name", "change", "status")


@query("implementation_slots", """SELECT coalesce(a.k, b.k) AS policy_id, CASE WHEN b.k IS NULL OR (a.k IS NOT NULL AND a.proc = b.proc) THEN a.proc ELSE b.proc END AS step,
  CASE WHEN b.k IS NULL OR (a.k IS NOT NULL AND a.proc = b.proc) THEN 'active' ELSE 'experimental' END AS status FROM (SELECT p_partkey AS k, p_name AS proc FROM part WHERE p_size > 10) a
 FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_name END AS proc FROM part WHERE p_size < 30) b ON a.k = b.k""")
def implementation_slots(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("policy_id"), F.lit("t").alias("trigger"), F.array("p_name").alias("procedure"), F.lit("active").alias("status"), "p_size")
    new = d.filter("p_size < 30").withColumn("procedure", F.when(F.col("p_size") % 3 == 0, F.transform("procedure", F.upper)).otherwise(F.col("procedure")))
    keyed = lambda x: x.withColumn("policy_id", F.col("policy_id").cast("string")).drop("p_size")
    return P.upsert_implementations(keyed(d.filter("p_size > 10")), keyed(new)).select(F.col("policy_id").cast("long").alias("policy_id"), F.get("procedure", 0).alias("step"), "status")


# One policy per step: the first slot whose holder it repeats is kept or taken over, else a slot is added.
@query("compact_registry", """WITH RECURSIVE p AS (SELECT p_brand AS family, 'policy-' || p_partkey AS policy_id, lower('handle ' || p_name || ' of ' || p_type) AS trigger,
    (p_size > 40)::INTEGER * 100000 + p_size AS strength, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i,
    list_distinct(regexp_extract_all(lower(p_name || ' rule keep ' || lower(p_type) || ' sizes near ' || (p_size % 7) || ' handle ' || p_name || ' of ' || p_type), '[a-z][a-z0-9_-]{2,}')) AS tokens FROM part),
  near AS MATERIALIZED (SELECT a.family, a.i, a.strength, list(a.trigger = b.trigger OR len(list_intersect(a.tokens, b.tokens)) / least(len(a.tokens), len(b.tokens))::DOUBLE >= 0.72 ORDER BY b.i) FILTER (b.i IS NOT NULL) AS near
    FROM p a LEFT JOIN p b ON a.family = b.family AND b.i < a.i GROUP BY ALL),
  f AS MATERIALIZED (SELECT family, list(strength ORDER BY i) AS strengths FROM p GROUP BY 1),
  r(family, i, held) AS (SELECT family, 0::BIGINT, []::BIGINT[] FROM f UNION ALL
    SELECT family, n.i, CASE WHEN coalesce(list_position(list_transform(held, lambda h: n.near[h]), true), 0) = 0 THEN list_append(held, n.i)
      WHEN n.strength > strengths[held[list_position(list_transform(held, lambda h: n.near[h]), true)]] THEN
        list_transform(range(1, len(held) + 1), lambda k: CASE WHEN k = list_position(list_transform(held, lambda h: n.near[h]), true) THEN n.i ELSE held[k] END)
      ELSE held END FROM r JOIN f USING (family) JOIN near n USING (family) WHERE n.i = r.i + 1),
  last AS (SELECT family, held FROM r QUALIFY row_number() OVER (PARTITION BY family ORDER BY i DESC) = 1),
  s AS (SELECT family, unnest(held) AS i, unnest(range(0, len(held))) AS slot FROM last)
  SELECT family, policy_id, slot FROM s JOIN p USING (family, i)""")
def compact_registry(spark, sf):
    d = _policies(spark, sf)
    d = d.withColumn("tokens", T.policy_tokens(F.col("name"), F.col("purpose"), F.col("trigger")))
    d = V.numbered(d, ["family"], ["p_partkey"], "pos", F.floor(F.col("p_partkey") / 100000))
    return P.compact_policies(d.select("family", "policy_id", "pos", "trigger", (F.col("status") == "active").alias("active"), "support", "tokens"))


def _shapes(spark, sf):
    """Substep shapes of each policy, and the words of each attempt's commands."""
    shapes = table(spark, sf, "part").select(
        F.concat(F.lit("policy-"), F.col("p_partkey").cast("string")).alias("policy_id"), F.lit(0).alias("pos"),
        F.concat(F.lit("python load tool report"), (F.col("p_partkey") % 100).cast("string"), F.lit(" openpyxl "), F.lower("p_name"), F.lit(" results")).alias("command_shape"))
    texts = V._event_base(spark, sf).select(
        "event_type", "k", F.concat_ws(":", "task_name", F.col("attempt_number").cast("string"), F.col("event_id").cast("string")).alias("attempt_id"),
        F.concat(F.lit("cat report"), F.col("k").cast("string"), F.lit(" with openpyxl for results "), F.when(F.col("k") % 2 == 0, "small bolt").otherwise("other")).alias("text"))
    return shapes, texts


@query("policy_occurrences", """WITH p AS (SELECT 'policy-' || p_partkey AS policy_id, list_distinct(list_filter(regexp_extract_all('load tool report' || (p_partkey % 100) || ' openpyxl ' || lower(p_name) || ' results', '[a-z][a-z0-9-]{2,}'), lambda w: w NOT IN ('when'))) AS toks FROM part),
 b AS (SELECT 'task-' || user_id || ':' || (CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS INTEGER) + 1) || ':' || event_id AS attempt_id, event_type, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events),
 t AS (SELECT attempt_id, list_distinct(regexp_extract_all('cat report' || k || ' openpyxl for results ' || CASE WHEN k % 2 = 0 THEN 'small bolt' ELSE 'other' END, '[a-z][a-z0-9-]{2,}')) AS words FROM b),
 pt AS (SELECT policy_id, len(toks) AS n, unnest(toks) AS token FROM p), tt AS (SELECT attempt_id, unnest(words) AS token FROM t),
 s AS (SELECT policy_id, attempt_id, count(*) AS shared, any_value(n) AS n FROM pt JOIN tt USING (token) GROUP BY 1, 2),
 e AS (SELECT policy_id, attempt_id FROM b JOIN p ON policy_id = 'policy-' || k WHERE event_type = 'purchase'),
 a AS (SELECT policy_id, attempt_id, 'explicit_policy_use' AS signal FROM e
   UNION ALL SELECT policy_id, attempt_id, 'command_shape_overlap_' || format('{:.2f}', round_even(shared / n::DOUBLE, 2)) FROM s ANTI JOIN e USING (policy_id, attempt_id) WHERE shared >= 3 AND shared / n::DOUBLE >= 0.3)
 SELECT policy_id, signal, count(*) AS attempts, min(attempt_id) AS first_attempt, max(attempt_id) AS last_attempt FROM a GROUP BY 1, 2""")
def policy_occurrences(spark, sf):
    """Where each policy occurs, by signal. Purchases name a policy, some that their words share as well."""
    shapes, texts = _shapes(spark, sf)
    used = texts.filter("event_type = 'purchase'").select("attempt_id", F.concat(F.lit("POLICY-"), F.col("k").cast("string")).alias("name"))
    return AU.occurrences(_policies(spark, sf), shapes, texts.select("attempt_id", "text"), used, summed=True)


def _audit(spark, sf):
    a = V.attempts(spark, sf).select("attempt_id", "task_name", "attempt_number", F.col("verifier_passed").alias("success"), F.col("attempt_number").alias("snapshot_number"))
    used = _used(spark, sf)
    pol = _policies(spark, sf)
    empty = pol.filter("false").select("policy_id", F.lit(0).alias("pos"), F.lit("").alias("command_shape"))
    hits = AU.occurrences(pol, empty, a.select("attempt_id", F.lit("").alias("text")), used)
    return AU.audit_rows(pol.select("policy_id", "status", "first_number", "has_substeps"), _observations(spark, sf), a, hits)


AUDIT_SQL = POL_SQL + """,
orig AS (SELECT o.policy_id, p.first_number, a.*, h.policy_id IS NOT NULL AS occurs FROM obs o JOIN pol p USING (policy_id) JOIN attempts a ON a.task_name = o.task_name AND (p.first_number IS NULL OR a.attempt_number < p.first_number)
   LEFT JOIN (SELECT DISTINCT policy_id, attempt_id FROM hits) h ON h.policy_id = o.policy_id AND h.attempt_id = a.attempt_id),
ot AS (SELECT policy_id, task_name, count(*) AS attempts, count(*) FILTER (attempt_number = 1 AND occurs) AS fo, count(*) FILTER (attempt_number > 1 AND occurs AND verifier_passed) AS ls,
   max(attempt_number) FILTER (attempt_number > 1 AND occurs AND verifier_passed) > min(attempt_number) FILTER (NOT verifier_passed) AS improved, arg_max(verifier_passed, attempt_number) AS fin, greatest(max(attempt_number) - 1, 0) AS r FROM orig GROUP BY 1, 2),
oo AS (SELECT policy_id, sum(attempts)::BIGINT AS oa, sum(fo)::BIGINT AS fo, sum(ls)::BIGINT AS ls, count(*) FILTER (improved) AS imp, count(*) FILTER (fin) AS ofs, avg(r) AS om FROM ot GROUP BY 1),
vt AS (SELECT DISTINCT first_number AS v FROM pol WHERE first_number IS NOT NULL),
st AS (SELECT v, task_name, arg_max(verifier_passed, attempt_number) AS fin, greatest(max(attempt_number) - 1, 0) AS r FROM vt JOIN attempts ON attempt_number >= v GROUP BY 1, 2),
ss AS (SELECT v, count(*) AS n, count(*) FILTER (fin) AS ok, avg(r) AS m FROM st GROUP BY 1),
seen AS (SELECT h.policy_id, count(DISTINCT task_name) AS ob, count(DISTINCT task_name) FILTER (attempt_number = 1 AND attempt_number >= first_number) AS ad FROM hits h JOIN pol USING (policy_id) GROUP BY 1),
has AS (SELECT DISTINCT policy_id FROM obs WHERE task_name IN (SELECT task_name FROM attempts)),
rows_ AS (SELECT policy_id, status AS policy_status, first_number, coalesce(ob, 0) AS observed_tasks, coalesce(n, 0) AS subsequent_tasks, coalesce(ad, 0) AS adopted_tasks, coalesce(fo, 0) AS first_attempt_occurrence, coalesce(ls, 0) AS later_successful_occurrence, coalesce(oa, 0) AS origin_attempts,
   coalesce(ofs, 0) AS origin_final_successes, coalesce(ok, 0) AS subsequent_final_successes, round(om, 3) AS origin_retry_mean, round(m, 3) AS subsequent_retry_mean, round_even(m - om, 3) AS retry_delta,
   CASE WHEN has.policy_id IS NULL OR first_number IS NULL OR NOT (has_substeps OR seen.policy_id IS NOT NULL) THEN 'low' WHEN ls > 0 AND imp > 0 AND fo = 0 THEN 'high' WHEN fo > 0 AND ls = 0 THEN 'medium' ELSE 'low' END AS label_confidence,
   CASE WHEN has.policy_id IS NULL OR first_number IS NULL OR NOT (has_substeps OR seen.policy_id IS NOT NULL) THEN 'ambiguous' WHEN ls > 0 AND imp > 0 AND fo = 0 THEN 'exploration-induced' WHEN fo > 0 AND ls = 0 THEN 'spontaneous' ELSE 'ambiguous' END AS heuristic_label
  FROM pol LEFT JOIN oo USING (policy_id) LEFT JOIN seen USING (policy_id) LEFT JOIN has USING (policy_id) LEFT JOIN ss ON v = first_number)"""


@query("policy_audit", f"WITH {AUDIT_SQL} SELECT * FROM rows_")
def policy_audit(spark, sf):
    return _audit(spark, sf)


@query("policy_audit_summary", f"""WITH {AUDIT_SQL}, l AS (SELECT unnest(['spontaneous', 'exploration-induced', 'task-specific', 'ambiguous']) AS heuristic_label)
 SELECT heuristic_label, count(policy_id) AS n, round(avg(CASE WHEN adopted_tasks > 0 THEN 1 WHEN policy_id IS NOT NULL THEN 0 END), 3) AS adoption_rate,
  round(CASE WHEN sum(subsequent_tasks) > 0 THEN sum(subsequent_final_successes) / sum(subsequent_tasks)::DOUBLE END, 3) AS subsequent_success_rate, round_even(avg(retry_delta), 3) AS retry_delta_mean FROM l LEFT JOIN rows_ USING (heuristic_label) GROUP BY 1""")
def policy_audit_summary(spark, sf):
    return AU.audit_summary(_audit(spark, sf))


@query("policy_ranking", "SELECT 'policy-' || p_partkey AS policy_id, row_number() OVER (ORDER BY p_size <= 40, 'policy-' || p_partkey)::INTEGER AS candidate_rank FROM part ORDER BY 2 LIMIT 30")
def policy_ranking(spark, sf):
    return P.rank_policies(_policies(spark, sf), 30).select("policy_id", "candidate_rank")


@query("policy_status_counts", "SELECT p_brand AS family, count(*) AS policies, count(*) FILTER (p_size <= 40) AS experimental_policies, count(*) FILTER (p_size > 40) AS active_policies FROM part GROUP BY 1")
def policy_status_counts(spark, sf):
    return P.status_counts(_policies(spark, sf), ["family"])


@query("origin_observations", """SELECT l_partkey, l_suppkey, l_returnflag, min(l_orderkey * 10 + l_linenumber) AS first_pos FROM lineitem GROUP BY ALL""")
def origin_observations(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("pos", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return P.distinct_observations(d, "l_partkey", ["l_suppkey", "l_returnflag"])


@query("first_observations", """WITH o AS (SELECT l_partkey, l_suppkey, l_returnflag, min(l_orderkey * 10 + l_linenumber) AS first_pos FROM lineitem GROUP BY ALL)
 SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY first_pos, l_suppkey, l_returnflag) <= 12""")
def first_observations(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("pos", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return P.distinct_observations(d, "l_partkey", ["l_suppkey", "l_returnflag"], 12)


@query("first_policy_versions", """SELECT l_partkey AS policy_id, 'v' || min(l_linenumber * 5) AS first_version, min(l_linenumber * 5) AS first_number FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1""")
def first_policy_versions(spark, sf):
    version = F.when(F.col("l_returnflag") == "R", "draft").otherwise(F.concat(F.lit("v"), (F.col("l_linenumber") * 5).cast("string")))
    return P.first_versions(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("policy_id"), version.alias("version")))


@query("epoch_versions", """SELECT o_custkey, year(o_orderdate)::INTEGER AS epoch_index, arg_max(CASE WHEN o_orderstatus = 'P' THEN 'promoted' ELSE 'snap' END || o_orderkey, o_orderkey) AS version FROM orders GROUP BY 1, 2""")
def epoch_versions(spark, sf):
    k = F.col("o_orderkey").cast("string")
    d = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("epoch_index"), F.col("o_orderkey").alias("batch_index"),
                                          F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("promoted"), k)).otherwise("").alias("promoted_version"), F.concat(F.lit("snap"), k).alias("snapshot_version"))
    return P.epoch_versions(d, ["o_custkey"])


FILES_SQL = """f AS (SELECT DISTINCT 'v' || n_nationkey AS version, c_mktsegment AS path, c_mktsegment AS sha FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 OR n_nationkey % 2 = 0),
 v AS (SELECT 'v' || n_nationkey AS version, 'v' || (n_nationkey - 1) AS parent_version FROM nation),
 s AS (SELECT version, string_agg(path || '=' || sha, '|' ORDER BY path) AS sig FROM f GROUP BY 1)"""


@query("unchanged_versions", f"WITH {FILES_SQL} SELECT v.version, parent_version, coalesce(a.sig, '') = coalesce(b.sig, '') AS workflow_only FROM v LEFT JOIN s a ON v.version = a.version LEFT JOIN s b ON parent_version = b.version")
def unchanged_versions(spark, sf):
    n = table(spark, sf, "nation")
    c = table(spark, sf, "customer")
    files = c.join(n, c["c_nationkey"] == n["n_nationkey"]).filter((F.col("c_acctbal") > 0) | (F.col("n_nationkey") % 2 == 0)).select(
        F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("version"), F.col("c_mktsegment").alias("path"), F.col("c_mktsegment").alias("sha"))
    versions = n.select(F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("version"), F.concat(F.lit("v"), (F.col("n_nationkey") - 1).cast("string")).alias("parent_version"))
    return P.unchanged_versions(files, versions)


# --- metrics (A1-A3, A9-A11, A14, W9, W10, J10) ---------------------------------------------

def _results(spark, sf):
    return V.attempts(spark, sf).select("task_family", "task_name", "attempt_id", F.col("attempt_number").alias("batch"), F.ceil(F.col("attempt_number") / 2).cast("int").alias("epoch"),
                                        F.col("verifier_passed").alias("success"), F.col("n_errors").alias("retries_used"), "n_steps", "reward", "attempt_number", F.col("n_steps").alias("pos"))


BM_SQL = V.merge_ctes(V.ATTEMPTS_SQL, """
bm AS (SELECT task_family, attempt_number AS batch, count(*) AS num_results, count(*) FILTER (verifier_passed) AS success_count, round_even(count(*) FILTER (verifier_passed) / count(*)::DOUBLE, 4) AS success_rate,
  count(*) FILTER (NOT verifier_passed) AS failure_count, sum(n_errors)::BIGINT AS total_retries FROM attempts GROUP BY 1, 2)""")


@query("batch_metrics", f"WITH {BM_SQL} SELECT * FROM bm")
def batch_metrics(spark, sf):
    return ME.batch_metrics(_results(spark, sf), ["task_family", "batch"])


@query("epoch_metrics", f"""WITH {V.ATTEMPTS_SQL}, r AS (SELECT ceil(attempt_number / 2.0)::INTEGER AS epoch, attempt_number AS batch, verifier_passed AS ok FROM attempts)
 SELECT epoch, batch, grouping(epoch, batch) AS level, count(*) AS num_results, count(*) FILTER (ok) AS success_count, count(*) FILTER (NOT ok) AS failure_count, round_even(count(*) FILTER (ok) / count(*)::DOUBLE, 4) AS success_rate FROM r GROUP BY ROLLUP (epoch, batch)""")
def epoch_metrics(spark, sf):
    return ME.epoch_metrics(_results(spark, sf), "epoch", "batch")


@query("evidence_counters", f"""WITH {V.ATTEMPTS_SQL} SELECT attempt_number AS batch, count(*) FILTER (verifier_passed) AS positive_anchors, count(*) FILTER (NOT verifier_passed) AS failure_attempts,
 count(*) FILTER (NOT verifier_passed AND n_steps <= 12) AS missing_trajectory_attempts, sum(n_errors)::BIGINT AS skipped_unreadable_artifacts FROM attempts GROUP BY 1""")
def evidence_counters(spark, sf):
    d = _results(spark, sf).withColumn("trajectory_available", F.col("n_steps") > 12).withColumn("skipped_files", F.col("retries_used"))
    return ME.evidence_counters(d, ["batch"])


@query("degradation_checks", f"""WITH {BM_SQL}, p AS (SELECT *, total_retries / num_results::DOUBLE AS mr FROM bm WHERE success_count > 0), w AS (SELECT *, lag(success_rate) OVER v AS pr, lag(mr) OVER v AS pm FROM p WINDOW v AS (PARTITION BY task_family ORDER BY batch)),
 f AS (SELECT *, coalesce((success_rate - pr) / nullif(pr, 0) < -0.2, false) AS a, coalesce((mr - pm) / nullif(pm, 0) > 0.2, false) AS b FROM w)
 SELECT task_family, batch, a AS rate_dropped, b AS retries_rose, a OR b AS degraded, CASE WHEN a AND b THEN 'critical' WHEN a OR b THEN 'warning' ELSE 'none' END AS severity FROM f""")
def degradation_checks(spark, sf):
    m = ME.batch_metrics(_results(spark, sf), ["task_family", "batch"]).withColumn("promoted", F.col("success_count") > 0)
    return ME.degradation(m, ["task_family"], "batch").select("task_family", "batch", "rate_dropped", "retries_rose", "degraded", "severity")


@query("success_trend", f"""WITH {BM_SQL}, t AS (SELECT task_family, arg_min(success_rate, batch) AS first_rate, arg_max(success_rate, batch) AS last_rate, count(*) AS batches FROM bm GROUP BY 1 HAVING count(*) >= 2)
 SELECT *, CASE WHEN last_rate > first_rate THEN 'improving' WHEN last_rate < first_rate THEN 'degrading' ELSE 'stable' END AS trend FROM t""")
def success_trend(spark, sf):
    return ME.trend(ME.batch_metrics(_results(spark, sf), ["task_family", "batch"]), ["task_family"], "batch")


def _reuse(spark, sf):
    a = _results(spark, sf).select("task_family", "batch", "attempt_id", F.col("success").alias("passed"))
    used = _used(spark, sf).select("attempt_id", F.col("name").alias("slug"))
    batches = a.select("task_family", "batch").distinct()
    p = _policies(spark, sf).filter("first_number is not null").select("slug", F.col("first_number"), (F.col("status") == "active").alias("active"),
                                                                      F.concat(F.lit("family-"), (F.col("p_partkey") % 7).cast("string")).alias("task_family"))
    d = batches.join(p, "task_family")
    known = d.filter(F.col("first_number") < F.col("batch")).select("task_family", "batch", "slug", "active")
    induced = d.filter(F.col("first_number") == F.col("batch")).select("task_family", "batch", "slug")
    return ME.reuse_metrics(a, used, known, induced, ["task_family"])


@query("reuse_metrics", f"""WITH {POL_SQL}, us AS (SELECT DISTINCT task_name || ':' || attempt_number AS attempt_id, CASE event_type WHEN 'error' THEN 'policy-' ELSE 'rule-' END || ((user_id * 7 + k * 13) % (SELECT max(p_partkey) + 1 FROM part)) AS slug FROM ev),
 b AS (SELECT DISTINCT task_family, attempt_number AS batch FROM attempts), fp AS (SELECT slug, first_number, status = 'active' AS active, 'family-' || (p_partkey % 7) AS task_family FROM pol WHERE first_number IS NOT NULL),
 known AS (SELECT task_family, batch, slug, active FROM b JOIN fp USING (task_family) WHERE first_number < batch), induced AS (SELECT task_family, batch, slug FROM b JOIN fp USING (task_family) WHERE first_number = batch),
 uses AS (SELECT a.task_family, attempt_number AS batch, verifier_passed AS passed, slug FROM us JOIN attempts a USING (attempt_id)),
 ex AS (SELECT task_family, count(*) FILTER ((task_family, attempt_number) IN (SELECT (task_family, batch) FROM known)) AS policy_exposures FROM attempts GROUP BY 1),
 re AS (SELECT task_family, count(*) AS e, count(*) FILTER (passed) AS s, count(*) FILTER (active) AS a, count(*) FILTER (active AND NOT passed) AS fa FROM uses JOIN known USING (task_family, batch, slug) GROUP BY 1),
 sb AS (SELECT task_family, count(*) AS sm FROM uses JOIN induced USING (task_family, batch, slug) GROUP BY 1)
 SELECT task_family, policy_exposures, coalesce(e, 0) AS explicit_reuses, coalesce(s, 0) AS successful_reuses, coalesce(a, 0) AS active_reuses, coalesce(fa, 0) AS failed_active_reuses, coalesce(sm, 0) AS same_batch_exposure,
  round(fa / nullif(a, 0)::DOUBLE, 6) AS false_promotion_rate, round(s / nullif(e, 0)::DOUBLE, 6) AS reuse_success FROM ex LEFT JOIN re USING (task_family) LEFT JOIN sb USING (task_family)""")
def reuse_metrics(spark, sf):
    d = _reuse(spark, sf)
    return d.withColumn("false_promotion_rate", F.round("false_promotion_rate", 6)).withColumn("reuse_success", F.round("reuse_success", 6))


@query("ablation_summary", """WITH f AS (SELECT o_orderstatus AS variant, o_orderpriority AS family, count(*) FILTER (o_custkey % 3 = 0) AS ok, count(*) AS n FROM orders GROUP BY ALL),
 r AS (SELECT o_orderstatus AS variant, o_orderpriority AS family, avg(CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS acc FROM orders GROUP BY ALL)
 SELECT variant, family, round(ok / n::DOUBLE, 6) AS train_final_accuracy, round(acc, 6) AS heldout_accuracy FROM f LEFT JOIN r USING (variant, family)""")
def ablation_summary(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("variant"), F.col("o_orderpriority").alias("family"), "o_custkey", "o_totalprice")
    fam = o.groupBy("variant", "family").agg(F.count_if(F.col("o_custkey") % 3 == 0).alias("final_epoch_successful"), F.count(F.lit(1)).alias("total_tasks"))
    res = o.select("variant", "family", F.when(F.col("o_custkey") % 5 != 0, F.when(F.col("o_totalprice") > 100000, 1.0).otherwise(0.5)).alias("reward"))
    d = ME.ablation_summary(fam, res, fam.select("variant", "family"))
    return d.select("variant", "family", F.round("train_final_accuracy", 6).alias("train_final_accuracy"), F.round("heldout_accuracy", 6).alias("heldout_accuracy"))


@query("aggregate_accuracy", """WITH f AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS s, count(*) AS t FROM orders GROUP BY 1) SELECT count(*) AS families_completed, sum(s)::BIGINT AS test_successful, sum(t)::BIGINT AS test_total, round(sum(s) / sum(t)::DOUBLE, 8) AS accuracy FROM f""")
def aggregate_accuracy(spark, sf):
    f = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("successful"), F.count(F.lit(1)).alias("total"))
    return ME.aggregate_accuracy(f).withColumn("accuracy", F.round("accuracy", 8))


@query("planned_results", """WITH r AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS p, arg_max(o_orderstatus, o_orderkey) AS s, max(o_orderkey) AS k FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
 SELECT c_name AS task_name, coalesce('trial-' || k, '') AS trial_name, coalesce(s = 'F', false) AS success, coalesce(p, 0.0) AS reward, CASE WHEN k IS NULL THEN 'test attempt produced no result' END AS exception_info FROM customer LEFT JOIN r ON c_custkey = o_custkey""")
def planned_results(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("task_name"))
    o = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    r = o.join(c, o["o_custkey"] == c["c_custkey"]).select("task_name", F.concat(F.lit("trial-"), F.col("o_orderkey").cast("string")).alias("trial_name"), (F.col("o_orderstatus") == "F").alias("success"),
                                                           F.col("o_totalprice").alias("reward"), F.lit(None).cast("string").alias("exception_info"), F.col("o_orderkey").alias("path"))
    return ME.planned_results(c, r)


@query("final_attempts", f"WITH {V.ATTEMPTS_SQL} SELECT task_name, arg_max(verifier_passed, attempt_number) AS final_success, max(attempt_number) - 1 AS max_retries FROM attempts GROUP BY 1")
def final_attempts(spark, sf):
    return ME.final_attempts(_results(spark, sf), ["task_name"])


# --- splits (K5-K9) -------------------------------------------------------------------------

@query("missing_split_names", """SELECT 'seg' AS family, 'Customer-' || o_orderkey AS task_name FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)""")
def missing_split_names(spark, sf):
    name = lambda c: F.concat(F.lit("Customer-"), F.col(c).cast("string")).alias("task_name")
    return SP.missing_names(table(spark, sf, "orders").select(F.lit("seg").alias("family"), name("o_orderkey")), table(spark, sf, "customer").select(F.lit("seg").alias("family"), name("c_custkey")))


@query("ranked_tasks", """WITH r AS (SELECT c_mktsegment AS family, c_name AS task_name, min(o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY ALL)
 SELECT c_mktsegment AS family, c_name AS task_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY coalesce(rank, 2147483647), c_name) AS position FROM customer LEFT JOIN r ON c_mktsegment = r.family AND c_name = r.task_name""")
def ranked_tasks(spark, sf):
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    r = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_mktsegment").alias("family"), F.concat(F.lit(" "), F.col("c_name")).alias("task_name"), F.col("o_orderkey").alias("rank"))
    return SP.ranked_tasks(c.select(F.col("c_mktsegment").alias("family"), F.col("c_name").alias("task_name")), r)


@query("split_report", """WITH s AS (SELECT c_mktsegment AS category, c_custkey AS task_id, c_acctbal < 1000 AS test, c_acctbal >= 900 AND c_nationkey <> 3 AS train FROM customer)
 SELECT category, count(*) FILTER (test AND train) AS overlap, 0::BIGINT AS duplicates, count(*) FILTER (NOT test AND NOT train) AS missing, 0::BIGINT AS extra, count(*) FILTER (train) AS n_train, count(*) FILTER (test) AS n_test,
  greatest(1, round_even(count(*) * 0.2, 0))::BIGINT AS expected_test, count(*) FILTER (test AND train) + count(*) FILTER (NOT test AND NOT train) = 0 AND count(*) FILTER (test) = greatest(1, round_even(count(*) * 0.2, 0)) AS valid FROM s GROUP BY 1""")
def split_report(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("category"), F.col("c_custkey").alias("task_id"), "c_acctbal", "c_nationkey")
    test = c.filter("c_acctbal < 1000").select("category", "task_id", F.lit("test").alias("part"))
    train = c.filter("c_acctbal >= 900 and c_nationkey <> 3").select("category", "task_id", F.lit("train").alias("part"))
    return SP.split_report(c.select("category", "task_id"), test.unionByName(train))


@query("epoch_batches", """SELECT c_mktsegment AS family, c_name AS task_name, row_number() OVER w AS position, ceil(row_number() OVER w / 3)::BIGINT AS batch_index FROM customer
  WINDOW w AS (PARTITION BY c_mktsegment ORDER BY sha256('43:' || c_name), c_name)""")
def epoch_batches(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("family"), F.col("c_name").alias("task_name"))
    d = SP.epoch_batches(c, ["family"], 42, 1, 3)
    return d.select("family", "task_name", F.col("position").cast("long").alias("position"), "batch_index")


@query("evidence_filters", W(CANDIDATES_SQL, V.ATTEMPTS_SQL, body="""SELECT 'full' AS variant, task_name, attempt_number, first_step, evidence_label FROM span_candidates
  UNION ALL SELECT 'success_only', task_name, attempt_number, first_step, evidence_label FROM span_candidates
  WHERE evidence_label = 'verified_success' AND (task_name, attempt_number) IN (SELECT (task_name, attempt_number) FROM attempts WHERE verifier_passed)"""))
def evidence_filters(spark, sf):
    """The candidates of each variant. What comes from first and second attempts is also there from an earlier batch."""
    attempts = V.attempts(spark, sf)
    c = cut_lineage(TR.span_candidates(V.calls(spark, sf), attempts).withColumn("substep_action", F.lit(None).cast("string")))
    new, prior = c.filter("attempt_number > 1"), c.filter("attempt_number <= 2")
    full = SP.discovery(new, attempts, prior).withColumn("variant", F.lit("full"))
    strict = SP.discovery(c, attempts, include_failures=False).withColumn("variant", F.lit("success_only"))
    return full.unionByName(strict).select("variant", "task_name", "attempt_number", "first_step", "evidence_label")


# --- streaming (ST2) ------------------------------------------------------------------------

STREAM_PARTS, STREAM_BUCKETS = 4, 8


@query("streamed_store", """SELECT 'm-' || left(sha256('task-' || user_id), 20) AS memory_id, arg_max(value, event_id) AS value, max(event_id) AS pos FROM events GROUP BY 1""")
def streamed_store(spark, sf):
    """The event table as a stream of several micro-batches, merged into a store by content id.

    Later batches win, so the parts follow event_id; rows with a null one, which never win, are in the first.
    """
    static = table(spark, sf, "events")
    low, top = static.agg(F.min("event_id"), F.max("event_id")).first()
    share = (F.col("event_id").cast("double") - F.lit(float(low or 0))) * STREAM_PARTS / (float(top or 0) - float(low or 0) + 1)
    part = F.coalesce(F.least(F.lit(STREAM_PARTS - 1), F.floor(share)), F.lit(0))
    folder = shared_folder(spark, "store")
    for k in range(STREAM_PARTS):      # each run of the stream takes all files of a part as one micro-batch
        static.filter(part == k).write.mode("append").parquet(f"{folder}/events")
        src = spark.readStream.schema(static.schema).parquet(f"{folder}/events")
        rec = src.select(F.concat(F.lit("m-"), F.substring(F.sha2(F.concat(F.lit("task-"), F.col("user_id").cast("string")), 256), 1, 20)).alias("memory_id"), "value",
                         F.col("event_id").alias("pos"), F.lit("memory").alias("representation"))
        ST.merge_stream(rec, f"{folder}/table", f"{folder}/offsets", M.MEMORY_PROMOTED, STREAM_BUCKETS).awaitTermination()
    return read_store(spark, f"{folder}/table").select("memory_id", "value", "pos")
