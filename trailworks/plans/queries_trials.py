"""Queries that render conversations as trial folders and read them back.

Conversation c is attempt c % 3 + 1 of task c div 3. Every fourth task has no manifest; its attempts are
direct trials with a result file or a reward file, and a trajectory document or a stream log.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import tables as TB
from ..sources import trajectories as S
from ..sources.files import write_files
from .catalog import query
from .queries_logs import _log_lines
from .views import table

STAGED = "k % 4 <> 3"


def _text(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def _convs(spark, sf):
    c = F.col("conv_id")
    d = table(spark, sf, "conversations").withColumn("k", F.floor(c / 3)).withColumn("number", (c % 3 + 1).cast("int"))
    d = d.withColumn("task", _text("t", F.col("k")))
    return d.withColumn("folder", F.when(F.expr(STAGED), _text(F.col("task"), "/attempts/attempt_", F.lpad(F.col("number").cast("string"), 2, "0"))).otherwise(_text("d", c)))


def _files(spark, sf):
    """(path, content) of all files of the tree."""
    c, turns = F.col("conv_id"), _convs(spark, sf)
    one = turns.select("conv_id", "k", "number", "task", "folder").distinct()
    out = []

    listed = F.when(c % 2 == 0, F.array(F.when(c % 3 == 0, "reflection_attempt_02.md").otherwise("reflection_attempt_01.md"), F.lit("notes.txt"))).otherwise(F.array().cast("array<string>"))
    item = F.struct("number", (c % 2 == 0).alias("success"), (c / 10).alias("reward"), F.when(c % 5 == 0, _text("lost ", c)).alias("exception_info"), listed.alias("reflection_files"))
    manifest = one.where(STAGED).groupBy("task").agg(F.to_json(F.struct(F.first("task").alias("task_name"), F.sort_array(F.collect_list(item)).alias("attempts"))).alias("content"))
    out.append(manifest.select(_text(F.col("task"), "/attempt_manifest.json").alias("path"), "content"))

    agent = F.col("role") == "assistant"
    result = F.struct(_text("out ", F.col("text")).alias("content"), (F.col("turn") % 2 == 1).alias("is_error"))
    extra = F.when(agent, F.struct(F.lit("Bash").alias("tool_use_name"), _text("u", F.col("turn")).alias("tool_use_id"), F.struct(_text("run ", F.col("turn")).alias("command")).alias("raw_arguments"), result.alias("tool_result_metadata")))
    step = F.struct("turn", F.struct(F.when(agent, "agent").otherwise("user").alias("source"), F.when(~agent, F.col("text")).alias("message"), extra.alias("extra")).alias("s"))
    with_steps = F.expr(f"CASE WHEN {STAGED} THEN conv_id % 5 <> 0 ELSE conv_id % 2 = 1 END")
    docs = turns.where(with_steps).groupBy("folder").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["s"]).alias("steps"))).alias("content"))
    out.append(docs.select(_text(F.col("folder"), "/agent/trajectory.json").alias("path"), "content"))

    logs = _log_lines(spark, sf).withColumn("conv_id", F.col("trial_path").cast("long")).join(one.where(f"NOT {STAGED} AND conv_id % 2 = 0"), "conv_id")
    logs = logs.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n").alias("content"))
    out.append(logs.select(_text(F.col("folder"), "/agent/claude-code.txt").alias("path"), "content"))

    told = one.where(f"{STAGED} AND conv_id % 4 <> 1")
    out.append(told.select(_text(F.col("folder"), "/reflection_attempt_01.md").alias("path"), _text(" cause ", c, "\n").alias("content")))
    out.append(told.where(c % 3 == 0).select(_text(F.col("folder"), "/reflection_attempt_02.md").alias("path"), _text("fix ", c).alias("content")))

    direct, reward = one.where(f"NOT {STAGED}"), (c % 3) / 2
    nested = F.to_json(F.struct(_text("rt", c).alias("task_name"), F.struct(F.struct(reward.alias("reward")).alias("rewards")).alias("verifier_result"), F.when(c % 9 == 0, "boom").alias("exception_info")))
    flat = F.to_json(F.struct(_text("trial-", c).alias("trial_name"), reward.alias("reward")))
    out.append(direct.where(c % 4 == 1).select(_text(F.col("folder"), "/result.json").alias("path"), nested.alias("content")))
    out.append(direct.where(c % 4 == 1).select(_text(F.col("folder"), "/config.json").alias("path"), F.to_json(F.struct(F.struct(_text("families/x/task-", c, "/").alias("path")).alias("task"))).alias("content")))
    out.append(direct.where(c % 4 == 3).select(_text(F.col("folder"), "/result.json").alias("path"), flat.alias("content")))
    out.append(direct.where(c % 4 == 2).select(_text(F.col("folder"), "/verifier/reward.txt").alias("path"), F.when(c % 8 == 2, " 1.0 \n").otherwise("none").alias("content")))
    files = out[0]
    for more in out[1:]:
        files = files.unionByName(more)
    return files


def _tree(spark, sf) -> str:
    root = shared_folder(spark, "trials")
    write_files(_files(spark, sf), root)
    return root


def _relative(path: str = "trial_path") -> Column:
    return F.regexp_extract(path, r"(t[0-9]+/attempts/attempt_[0-9]+|d[0-9]+)$", 1)


CONVS = """v AS (SELECT DISTINCT conv_id AS c, conv_id // 3 AS k, (conv_id % 3 + 1)::INTEGER AS number, 't' || conv_id // 3 AS task, (conv_id // 3) % 4 <> 3 AS staged FROM conversations),
 f AS (SELECT *, CASE WHEN staged THEN task || '/attempts/attempt_' || lpad(number::VARCHAR, 2, '0') ELSE 'd' || c END AS trial,
   CASE WHEN staged THEN c % 5 <> 0 ELSE c % 2 = 1 END AS doc, NOT staged AND c % 2 = 0 AS log FROM v)"""
REFLECTION = """CASE WHEN NOT staged OR c % 4 = 1 THEN '' WHEN c % 2 = 0 AND c % 3 = 0 THEN 'fix ' || c WHEN c % 2 = 0 OR c % 3 <> 0 THEN 'cause ' || c
  ELSE 'cause ' || c || chr(10) || chr(10) || 'fix ' || c END"""
REWARD = """CASE WHEN staged THEN c / 10 WHEN c % 4 IN (1, 3) THEN (c % 3) / 2 WHEN c % 8 = 2 THEN 1.0 END"""


@query("trial_manifests", f"""WITH {CONVS} SELECT task AS task_name, number AS attempt_number, task || ':' || number AS attempt_id, trial, c % 2 = 0 AS verifier_passed, c / 10 AS reward,
 CASE WHEN c % 5 = 0 THEN 'lost ' || c END AS exception_info, CASE WHEN c % 2 = 0 THEN 2 ELSE 0 END AS listed FROM f WHERE staged""")
def trial_manifests(spark, sf):
    d = S.manifests(spark, _tree(spark, sf))
    return d.select("task_name", "attempt_number", "attempt_id", _relative().alias("trial"), "verifier_passed", "reward", "exception_info", F.size("listed_files").alias("listed"))


DOC_STEPS = f"""{CONVS}, s AS (SELECT trial, turn, role = 'assistant' AS agent, text, row_number() OVER (PARTITION BY trial ORDER BY turn)::INTEGER AS step_idx FROM conversations JOIN f ON c = conv_id WHERE doc)"""


@query("trial_steps", f"""WITH {DOC_STEPS} SELECT trial, step_idx, CASE WHEN agent THEN 'agent' ELSE 'user' END AS source, sha256(CASE WHEN agent THEN '' ELSE text END) AS message,
 CASE WHEN agent THEN 'Bash' END AS tool_name, CASE WHEN agent THEN 'u' || turn END AS tool_use_id, CASE WHEN agent THEN 'run ' || turn END AS command,
 sha256(CASE WHEN agent THEN 'out ' || text ELSE '' END) AS result, agent AND turn % 2 = 1 AS is_error FROM s""")
def trial_steps(spark, sf):
    d = S.step_files(spark, _tree(spark, sf))
    return d.select(_relative().alias("trial"), "step_idx", "source", F.sha2("message", 256).alias("message"), "tool_name", "tool_use_id", F.col("args")["command"].alias("command"),
                    F.sha2(F.coalesce("result_text", F.lit("")), 256).alias("result"), "is_error")


@query("trial_reflections", f"""WITH {CONVS} SELECT trial, {REFLECTION} AS reflection, CASE WHEN c % 2 = 0 OR c % 3 <> 0 THEN 1 ELSE 2 END AS n_files FROM f WHERE staged AND c % 4 <> 1""")
def trial_reflections(spark, sf):
    root = _tree(spark, sf)
    listed = S.manifests(spark, root).select("trial_path", F.explode("listed_files").alias("name")).where("name like 'reflection_attempt_%.md'")
    d = S.joined_reflections(S.reflections(spark, root), listed)
    return d.select(_relative().alias("trial"), "reflection", F.size("reflection_files").alias("n_files"))


@query("trial_outcomes", f"""WITH {CONVS} SELECT trial, {REWARD} AS reward, coalesce({REWARD} >= 1.0, false) AS verifier_passed FROM f WHERE NOT staged""")
def trial_outcomes(spark, sf):
    return S.outcomes(spark, _tree(spark, sf)).select(_relative().alias("trial"), "reward", "verifier_passed")


@query("collected_results", f"""WITH {CONVS} SELECT CASE WHEN c % 4 = 1 THEN 'task-' || c ELSE trial END AS task_name, CASE WHEN c % 4 = 1 THEN trial ELSE 'trial-' || c END AS trial_name, (c % 3) / 2 AS reward,
 CASE WHEN c % 4 = 1 AND c % 9 = 0 THEN 'boom' END AS exception_info, NOT (c % 4 = 1 AND c % 9 = 0) AND c % 3 = 2 AS success FROM f WHERE NOT staged AND c % 4 IN (1, 3)""")
def collected_results(spark, sf):
    return S.collect_results(spark, _tree(spark, sf)).select("task_name", "trial_name", "reward", "exception_info", "success")


@query("missing_trajectories", f"""WITH {CONVS} SELECT task AS task_name, number AS attempt_number, 'lost ' || c AS exception_info FROM f WHERE staged AND c % 2 = 1 AND c % 5 = 0""")
def missing_trajectories(spark, sf):
    return S.missing_trajectories(spark, _tree(spark, sf))


@query("loaded_attempts", f"""WITH {CONVS}, r AS (SELECT *, {REFLECTION} AS reflection, {REWARD} AS reward FROM f)
 SELECT 'family' AS task_family, CASE WHEN staged THEN task ELSE trial END AS task_name, CASE WHEN staged THEN number ELSE 1 END AS attempt_number, CASE WHEN staged THEN task || ':' || number ELSE trial END AS attempt_id,
 trial, CASE WHEN staged THEN c % 2 = 0 ELSE coalesce(reward >= 1.0, false) END AS verifier_passed, reward, reflection FROM r WHERE doc OR log OR reflection <> ''""")
def loaded_attempts(spark, sf):
    attempts, _ = S.load_trials(spark, _tree(spark, sf), "family")
    return attempts.select("task_family", "task_name", "attempt_number", "attempt_id", _relative().alias("trial"), "verifier_passed", "reward", "reflection")


@query("loaded_steps", f"""WITH {DOC_STEPS},
 l AS (SELECT trial, turn, role = 'assistant' AS agent, text, conv_id % 4 <> 0 AND role = 'assistant' AS answered FROM conversations JOIN f ON c = conv_id WHERE log),
 g AS (SELECT trial, turn, 0 AS block, CASE WHEN agent THEN left(text, 300) ELSE left(text, 1000) END AS message, NULL::VARCHAR AS tool, '' AS result FROM l WHERE trim(text) <> ''
  UNION ALL SELECT trial, turn, 1, '', 'Bash', CASE WHEN NOT answered THEN '' WHEN turn % 3 = 0 THEN left('second ' || text, 2000) ELSE left('first ' || text, 2000) END FROM l WHERE agent),
 a AS (SELECT trial, step_idx::BIGINT AS step_idx, CASE WHEN agent THEN '' ELSE text END AS message, CASE WHEN agent THEN 'Bash' END AS tool_name, CASE WHEN agent THEN 'out ' || text ELSE '' END AS result FROM s
  UNION ALL SELECT trial, row_number() OVER (PARTITION BY trial ORDER BY turn, block), message, tool, result FROM g)
 SELECT CASE WHEN staged THEN task ELSE f.trial END AS task_name, CASE WHEN staged THEN number ELSE 1 END AS attempt_number, step_idx, sha256(message) AS message, tool_name, sha256(result) AS result FROM a JOIN f ON f.trial = a.trial""")
def loaded_steps(spark, sf):
    _, steps = S.load_trials(spark, _tree(spark, sf), "family")
    return steps.select("task_name", "attempt_number", F.col("step_idx").cast("long").alias("step_idx"), F.sha2("message", 256).alias("message"), "tool_name",
                        F.sha2(F.coalesce("result_text", F.lit("")), 256).alias("result"))


@query("delimited_lines", """SELECT upper(lower(c_mktsegment)) AS segment, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE round(c_acctbal, 2) END AS balance FROM customer""")
def delimited_lines(spark, sf):
    """Customers as tab-separated text with thousands separators and bad numbers, read as text, then cast."""
    c = table(spark, sf, "customer")
    folder = shared_folder(spark, "lines")
    shown = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.format_number(F.round("c_acctbal", 2), 2))
    c.select(F.lower("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), shown.alias("balance")).write.option("header", "true").csv(folder, sep="\t")
    return TB.read_delimited(spark, folder, ["segment", "name", "balance"], "\t", numeric=("balance",), upper=("segment",))


@query("partitioned_evidence", """SELECT c_mktsegment AS task_family, c_nationkey % 3 AS epoch, count(*) AS n, sum(c_custkey)::BIGINT AS total FROM customer GROUP BY ALL
 UNION ALL SELECT 'log', -1, 2 * count(*), 2 * sum(c_custkey)::BIGINT FROM customer""")
def partitioned_evidence(spark, sf):
    """A folder for each family and epoch; and a log of JSON lines that is appended to twice."""
    folder = shared_folder(spark, "evidence")
    d = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("task_family"), (F.col("c_nationkey") % 3).alias("epoch"), F.col("c_custkey").alias("key"))
    TB.write_partitioned(d, f"{folder}/batches", ["task_family", "epoch"])
    for _ in range(2):
        TB.append_log(d, f"{folder}/log")
    back = spark.read.parquet(f"{folder}/batches").groupBy("task_family", F.col("epoch").cast("int").alias("epoch")).agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("total"))
    log = spark.read.schema(d.schema).json(f"{folder}/log").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("total"))
    return back.unionByName(log.select(F.lit("log").alias("task_family"), F.lit(-1).alias("epoch"), "n", "total"))
