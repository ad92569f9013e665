"""Memory ids, merges, retrieval, clustering, policies and streams."""

import hashlib
import json
import random

import numpy as np
from pyspark.sql import functions as F

from trailworks.functions import text as T
from trailworks.operators import audit as AU
from trailworks.operators import clustering as CL
from trailworks.operators import memory as M
from trailworks.operators import policies as P
from trailworks.operators import retrieval as RT
from trailworks.operators import retry as R
from trailworks.streaming import jobs as ST
from trailworks.streaming.store import read_store


def _hash(record):
    text = json.dumps(record, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return "memory-" + hashlib.sha256(text.encode()).hexdigest()[:20]


def test_memory_ids_equal_hashes_of_sorted_compact_json(spark):
    a = spark.createDataFrame([("fä", "t/1", 1, False, 'ROOT CAUSE: "quoted" ß and 1/2\nCORRECTIVE ACTION: do')],
                              "task_family string, task_name string, attempt_number int, verifier_passed boolean, reflection string")
    row = M.memory_records(R.retry_links(a)).first()
    assert row.memory_id == _hash({
        "task_family": "fä", "task_name": "t/1", "attempt_number": 1, "candidate_kind": None, "intent": None, "lesson": row.lesson, "rationale": row.rationale,
        "retry_outcome": "missing", "retry_transition": {"from_attempt": 1, "to_attempt": 2, "retry_verifier_passed": None}})
    c = spark.createDataFrame([("c1", "f", "t", 2, "in", "ob", "re", "verified_success", "reflection", "success", "workflow"), ("c2", "f", "t", 2, "in", "ob", "re", "x", "trajectory", None, "workflow")],
                              "candidate_id string, task_family string, task_name string, attempt_number int, intent string, obstacle string, resolution string, evidence_label string, evidence_source string, retry_outcome string, candidate_kind string")
    got = {x.candidate_id: x.memory_id for x in M.policy_candidate_records(c).collect()}
    base = {"task_family": "f", "task_name": "t", "attempt_number": None, "candidate_kind": "workflow", "intent": "in", "lesson": "re", "rationale": "ob"}
    assert got["c1"] == _hash({**base, "retry_outcome": "success", "retry_transition": {"from_attempt": 2, "to_attempt": 3, "retry_verifier_passed": True}})
    assert got["c2"] == _hash({**base, "retry_outcome": None, "retry_transition": {}})


MEMORY = "record_id string, text string, r_vec array<float>"
SCHEDULE = "Validate timezone constraints and persist the corrected meeting schedule. schedule-planning-1"
OFFER = "Inspect every document part and remove all unreplaced template markers. offer-letter-generator-2"


def _search(spark, records, query, vector):
    r = spark.createDataFrame(records, MEMORY)
    q = spark.createDataFrame([(1, query, vector)], "query_id int, query string, q_vec array<float>")
    return RT.search(r, q, 5).collect()


def test_retrieval_gates(spark):
    one = [("schedule", SCHEDULE, None)]
    assert _search(spark, one, "DOCX template placeholder replacement conditional section formatting validation", None) == []
    hit = _search(spark, one, "timezone meeting schedule", None)
    assert [(x.record_id, x.match_mode) for x in hit] == [("schedule", "lexical_exact")]
    both = [("schedule", SCHEDULE, [1.0, 0.0]), ("offer", OFFER, [0.0, 1.0])]
    hit = _search(spark, both, "prepare a candidate employment document", [0.0, 1.0])
    assert [(x.record_id, x.match_mode, x.semantic_score) for x in hit] == [("offer", "hybrid", 1.0)]
    assert _search(spark, [("schedule", SCHEDULE, [1.0, 0.0])], "replace placeholders in a word processing file", [0.0, 1.0]) == []


def _greedy(items, threshold):
    """First fit over points in fingerprint order; copies are separate points."""
    clusters = []
    for fp, v in sorted(items, key=lambda x: x[0]):
        for c in clusters:
            if all(np.float32(v @ w) >= np.float32(threshold) for _, w in c):
                c.append((fp, v))
                break
        else:
            clusters.append([(fp, v)])
    return clusters


def test_clustering_matches_first_fit_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(CL, "BLOCK_ROWS", 16)
    monkeypatch.setattr(CL, "MEMBER_CHUNK", 5)
    r = np.random.default_rng(4)
    centers = r.normal(size=(6, 8))
    rows, pools = [], {}
    for i in range(70):
        v = centers[i % 6] + r.normal(size=8) * 0.45
        v = (v / np.linalg.norm(v)).astype(np.float32)
        fp = hashlib.sha256(str(i).encode()).hexdigest()
        pool = ("f", "workflow" if i % 3 else "atomic_substep")
        for _ in range(1 + i % 2):
            rows.append((*pool, fp, [float(x) for x in v]))
            pools.setdefault(pool, []).append((fp, v))
    d = spark.createDataFrame(rows, "task_family string, candidate_kind string, fingerprint string, vector array<float>")
    placed = CL.cluster_points(d)
    got = {}
    for x in placed.collect():
        got.setdefault((x.task_family, x.candidate_kind, x.cluster), set()).add(x.fingerprint)
    want, reps = set(), {}
    for pool, items in pools.items():
        for c in _greedy(items, 0.75):
            want.add((*pool, frozenset(fp for fp, _ in c)))
            if len(c) > 1:
                best = min(range(len(c)), key=lambda i: (-round(float(np.mean([float(c[i][1] @ c[j][1]) for j in range(len(c)) if j != i])), 6), c[i][0]))
                reps[pool[1], frozenset(fp for fp, _ in c)] = c[best][0]
    assert {(k[0], k[1], frozenset(v)) for k, v in got.items()} == want
    for x in CL.representatives(placed).collect():
        members = frozenset(got[x.task_family, x.candidate_kind, x.cluster])
        if (x.candidate_kind, members) in reps and len(members) > 2:
            assert x.representative == reps[x.candidate_kind, members]


def test_support_gate_and_quality_gate(spark):
    m = spark.createDataFrame([("a", "t1", "verified_success"), ("a", "t2", "unresolved_failure"), ("a", "t3", "tool_recovery"), ("b", "t1", "verified_success"),
                               ("b", "t2", "verified_success"), ("b", "t3", "unresolved_failure")], "capability_id string, task_name string, evidence_label string")
    got = {x.capability_id: (x.support, x.qualifying_tasks, x.publishable) for x in CL.cluster_support(m).collect()}
    assert got == {"a": (3, 2, False), "b": (3, 3, True)}
    c = m.select("capability_id").distinct()
    q = spark.createDataFrame([("a", "high", 0.9), ("b", "high", 0.6)], "cluster_id string, quality string, confidence double")
    assert [x.capability_id for x in CL.quality_gate(c, q).collect()] == ["a"] and CL.quality_gate(c, None).count() == 2


def test_merge_mark_and_prior(spark):
    old = spark.createDataFrame([("m1", "c1", "memory_residual", "old"), ("m2", "c2", "memory", "old")], "memory_id string, candidate_id string, representation string, lesson string")
    new = spark.createDataFrame([("m1", "c1", "memory", "new"), ("m3", "c3", "memory", "new")], old.schema)
    got = {x.memory_id: (x.representation, x.lesson) for x in M.merge_store(old, new, M.MEMORY_PROMOTED).collect()}
    assert got == {"m1": ("memory_residual", "new"), "m2": ("memory", "old"), "m3": ("memory", "new")}
    cand = spark.createDataFrame([("p1", "c2", "candidate", ""), ("p2", "c9", "candidate", "")], old.schema)
    mem, can = M.mark_compiled(old, cand, spark.createDataFrame([("p1",)], "id string"))
    assert {x.memory_id: x.representation for x in mem.collect()} == {"m1": "memory_residual", "m2": "memory_residual"}
    assert {x.memory_id: x.representation for x in can.collect()} == {"p1": "skill_factored", "p2": "candidate"}
    # Merging the same batch twice changes nothing.
    once = M.merge_store(old, new, M.MEMORY_PROMOTED)
    assert sorted(M.merge_store(once, new, M.MEMORY_PROMOTED).collect()) == sorted(once.collect())


def test_near_duplicate_policies_follow_the_greedy_rule(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 5)
    r = random.Random(8)
    words = [f"w{i:02d}" for i in range(12)]
    rows = [(f"f{f}", f"p{f}-{i}", i, f"trigger {r.randrange(18)}", r.random() < 0.3, r.randrange(4), r.sample(words, r.randrange(3, 8)))
            for f in range(3) for i in range(1, 38)]
    d = spark.createDataFrame(rows, "family string, policy_id string, pos long, trigger string, active boolean, support long, tokens array<string>")
    got = {(x.family, x.slot): x.policy_id for x in P.compact_policies(d).collect()}
    want = {}
    for f in range(3):
        slots = []
        for row in [x for x in rows if x[0] == f"f{f}"]:
            for s, other in enumerate(slots):
                shared = len(set(row[6]) & set(other[6])) / min(len(row[6]), len(other[6]))
                if row[3] == other[3] or shared >= 0.72:
                    if (row[4], row[5]) > (other[4], other[5]):
                        slots[s] = row
                    break
            else:
                slots.append(row)
        want.update({(f"f{f}", s): x[1] for s, x in enumerate(slots)})
    assert got == want


def test_promotion_needs_explicit_use_on_another_task(spark):
    pol = spark.createDataFrame([("p1", "s1", "experimental"), ("p2", "s2", "experimental"), ("p3", "s3", "experimental")], "policy_id string, slug string, status string")
    obs = spark.createDataFrame([("p1", "t1"), ("p2", "t1")], "policy_id string, t string").select("policy_id", T.task_fingerprint(F.col("t")).alias("task_fingerprint"))
    att = spark.createDataFrame([("t1:2", "t1", True), ("t2:1", "t2", True), ("t3:1", "t3", False)], "attempt_id string, task_name string, verifier_passed boolean")
    used = spark.createDataFrame([("t1:2", "s1"), ("t2:1", "p2"), ("t3:1", "s1"), ("t2:1", "s3")], "attempt_id string, name string")
    got = {x.policy_id: x.status for x in P.promotions(pol, obs, att, used, strict_cross_task=True).collect()}
    assert got == {"p1": "experimental", "p2": "active", "p3": "experimental"}
    got = {x.policy_id: x.evidence for x in P.promotions(pol, obs, att, used).collect()}
    assert got == {"p1": 1, "p2": 1, "p3": 0}


def test_streams_merge_and_join(spark, tmp_path):
    schema = "memory_id string, representation string, lesson string, pos long"
    src = tmp_path / "in"
    for i, rows in enumerate([[("m1", "memory_residual", "a", 1), ("m2", "memory", "a", 2)], [("m1", "memory", "b", 3), ("m3", "memory", "b", 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = ST.merge_stream(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "store"), str(tmp_path / "ck"), "memory_residual")
        q.awaitTermination()
    got = {x.memory_id: (x.representation, x.lesson) for x in read_store(spark, str(tmp_path / "store")).collect()}
    assert got == {"m1": ("memory_residual", "b"), "m2": ("memory", "a"), "m3": ("memory", "b")}
    members = "capability_id string, task_name string, evidence_label string"
    for rows in ([("c", "t1", "verified_success"), ("c", "t2", "tool_recovery")], [("c", "t1", "verified_success"), ("c", "t3", "unresolved_failure")]):
        spark.createDataFrame(rows, members).coalesce(1).write.mode("append").parquet(str(tmp_path / "mem"))
        ST.count_support(spark.readStream.schema(members).parquet(str(tmp_path / "mem")), str(tmp_path / "support"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "support")).count() == 2
    logs = tmp_path / "logs" / "trial" / "agent"
    logs.mkdir(parents=True)
    lines = [{"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}]}},
             {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "out", "is_error": False}]}}]
    (logs / "claude-code.txt").write_text("\n".join(json.dumps(x) for x in lines))
    ST.ingest_calls(ST.read_log_stream(spark, str(tmp_path / "logs")), str(tmp_path / "calls"), str(tmp_path / "ck3")).awaitTermination()
    row = read_store(spark, str(tmp_path / "calls")).first()
    assert (row.tool_name, row.result_text, row.is_error) == ("Bash", "out", False)


def test_workflow_estimate_counts_versions_without_file_changes(spark):
    files = spark.createDataFrame([("v1", "a.md", "x"), ("v2", "a.md", "x"), ("v3", "a.md", "y")], "version string, path string, sha string")
    versions = spark.createDataFrame([("v0", None), ("v1", "v0"), ("v2", "v1"), ("v3", "v2")], "version string, parent_version string")
    updates = spark.createDataFrame([("v2",), ("v2",), ("v3",)], "version string")
    row = P.workflow_estimate(updates, versions, files).first()
    assert (row.workflow_update_records, row.workflow_only_version_estimate) == (3, 1)


def test_streamed_store_takes_rows_with_null_and_negative_ids(spark, tmp_path):
    import duckdb

    from trailworks.plans import catalog

    catalog.load()
    rows = [(i, i % 7, float(i)) for i in range(40)] + [(-5, 1, 0.5), (-3, 20, 1.5), (-9, 20, 2.5), (None, 2, 3.5), (None, 21, None)]
    for name, some in (("a", rows), ("b", [x for x in rows if x[0] is not None and x[0] < 0])):
        sf = tmp_path / name
        spark.createDataFrame(some, "event_id long, user_id long, value double").repartition(3).write.parquet(f"{sf}/events.parquet")
        got = catalog.JOBS["streamed_store"](spark, str(sf)).select("memory_id", "value", "pos").collect()
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
        assert {tuple(r) for r in got} == set(con.execute(catalog.SQL["streamed_store"]).fetchall())
        assert len(got) == len({x[1] for x in some})


def test_occurrences_are_summed_without_pairs(spark):
    """Sums equal those of the rows; many policies and attempts of few shapes and texts never meet one by one."""
    def both(n, m):
        policies = spark.createDataFrame([(f"p-{i}", f"rule-{i}") for i in range(n)], "policy_id string, slug string")
        shapes = spark.createDataFrame([(f"p-{i}", k, f"load report{(i + k) % 3} openpyxl results small") for i in range(n) for k in range(1 + i % 2)],
                                       "policy_id string, pos int, command_shape string")
        texts = [(f"a{j:05d}", f"openpyxl results report{j % 4}") for j in range(m)] + [("a00001", "openpyxl results report2"), (None, "openpyxl results report1")]
        used = spark.createDataFrame([(f"a{j:05d}", ("P-" if j % 2 else "rule-") + str(j % 7)) for j in range(0, m, 3)] + [("a00000", "p-1"), ("zz", "p-2")], "attempt_id string, name string")
        args = policies, shapes, spark.createDataFrame(texts, "attempt_id string, text string"), used
        return AU.occurrences(*args), AU.occurrences(*args, summed=True)

    pairs, sums = both(9, 60)
    want = pairs.groupBy("policy_id", "signal").agg(F.count(F.lit(1)), F.min("attempt_id"), F.max("attempt_id"))
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, want.collect())) and sums.count() > 9
    _, sums = both(3000, 4000)
    assert sums.agg(F.sum("attempts")).first()[0] > 2_500_000
    from trailworks.operators import overlap
    most, join = [], overlap.candidate_pairs
    AU.candidate_pairs = lambda *a: most.append(join(*a)) or most[-1]
    try:
        both(3000, 4000)
    finally:
        AU.candidate_pairs = join
    assert max(d.count() for d in most) <= 12


def test_rounds_of_clustering_keep_one_plan(spark, monkeypatch):
    """Ten rounds: what was placed is read from one table, and the clusters are those of a single round."""
    r = np.random.default_rng(3)
    base = r.normal(size=(12, 8))
    points = [("f", "workflow", hashlib.sha256(str(i).encode()).hexdigest(), [float(x) for x in v / np.linalg.norm(v)])
              for i, v in enumerate(base[r.integers(0, 12, 100)] + r.normal(scale=0.2, size=(100, 8)))]
    d = spark.createDataFrame(points, "task_family string, candidate_kind string, fingerprint string, vector array<float>")
    groups = lambda x: {frozenset(q.m) for q in x.groupBy("cluster").agg(F.collect_list("fingerprint").alias("m")).collect()}
    want = groups(CL.cluster_points(d))
    monkeypatch.setattr(CL, "BLOCK_ROWS", 10)
    placed = CL.cluster_points(d)
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation") == 1
    assert groups(placed) == want and placed.count() == 100


def test_vectors_travel_in_tiles(spark):
    """All blocks meet, but a vector is sent once for each tile of the other side, not for each block."""
    r = np.random.default_rng(4)
    v = r.normal(size=(400, 3))
    rows = spark.createDataFrame([(i, [float(x) for x in y]) for i, y in enumerate(v)], "record_id long, r_vec array<double>")
    pairs = RT.similar_pairs(rows.withColumnsRenamed({"record_id": "query_id", "r_vec": "q_vec"}), rows, 0.2, size=4)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.2))}
    got = [(x.query_id, x.record_id) for x in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = pairs._jdf.queryExecution().optimizedPlan()
    sent = [plan.children().apply(k) for k in range(2)] if plan.children().size() == 2 else []
    dataset = spark._jvm.org.apache.spark.sql.classic.Dataset
    assert sent and all(dataset.ofRows(spark._jsparkSession, side).count() <= 400 * RT.TILES[1] for side in sent)


def test_a_vector_is_made_for_each_text_and_weighs_its_copies(spark, monkeypatch):
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.functions import vector_to_array

    from trailworks.plans import evidence as EV

    rows = [("f", "workflow", f"read sheet {'abc'[i % 3]}", f"file {'xy'[i % 2]} missing") for i in range(30)] + [(None, "workflow", "of no family", "none")]
    d = spark.createDataFrame([(f"c{i}", f"t{i % 5}", "verified_success", *r) for i, r in enumerate(rows)],
                              "candidate_id string, task_name string, evidence_label string, task_family string, candidate_kind string, intent string, obstacle string")
    texts = d.withColumn("text", T.embedding_text(d.intent, d.obstacle))
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=64).transform(texts.withColumn("tokens", T.retrieval_tokens(texts.text)))
    plain = IDF(inputCol="tf", outputCol="idf").fit(tf).transform(tf).select("text", vector_to_array("tf").alias("tf"), vector_to_array("idf").alias("idf")).collect()
    want = {}
    for r in plain:
        v = np.array(r.tf) + np.array(r.idf)
        want[r.text] = v / np.sqrt((v * v).sum())
    some = texts.groupBy("text").count()
    for got in (RT.hashed_vectors(texts, "text", 64), RT.hashed_vectors(some, "text", 64, copies="count")):
        for r in got.collect():
            assert np.allclose(r.vector, want[r.text], atol=1e-6)

    seen, made = [], RT.hashed_vectors
    monkeypatch.setattr(RT, "hashed_vectors", lambda x, *a, **b: seen.append(x.count()) or made(x, *a, **b))
    clusters, members = EV.cluster(d)
    assert seen == [7] and members.count() == 30
    assert sum(r.members for r in clusters.collect()) == 30
