"""Queries that render driver tables as JSON log lines and read them back through the log operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import errors as E
from ..operators import clustering as CL
from ..session import shared_folder
from ..sources import trajectories as S
from ..streaming import jobs as ST
from ..streaming.store import read_store
from .catalog import query
from .views import table


def _log_lines(spark, sf, use=None, answered_use=None):
    """Conversations as a stream log: a line per turn; assistants also call a tool, and most calls are answered.

    Line 10 * turn is the turn; 10 * turn + 3 and + 5 are results. Turns divisible by three are answered
    twice (the last answer counts), odd ones with an error flag, every fourth conversation never.
    """
    d = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("trial_path"), "conv_id", "turn", "role", "text")
    use = F.concat(F.lit("u-"), F.col("turn").cast("string")) if use is None else use
    answered_use = use if answered_use is None else answered_use
    call = F.struct(F.lit("tool_use").alias("type"), use.alias("id"), F.lit("Bash").alias("name"), F.struct(
        F.concat(F.lit("run step "), F.col("turn").cast("string")).alias("command")).alias("input"))
    said = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    pair = F.concat(F.lit("["), F.to_json(said), F.lit(","), F.to_json(call), F.lit("]"))
    body = F.when(F.col("role") == "assistant", pair).otherwise(F.to_json(F.array(said)))
    turn = F.concat(F.lit('{"type":"'), F.when(F.col("role") == "assistant", "assistant").otherwise("user"), F.lit('","message":{"content":'), body, F.lit("}}"))

    def result(name: str, wrong):
        block = F.struct(F.lit("tool_result").alias("type"), answered_use.alias("tool_use_id"), F.concat(F.lit(f"{name} "), F.col("text")).alias("content"), wrong.alias("is_error"))
        return F.concat(F.lit('{"type":"user","message":{"content":'), F.to_json(F.array(block)), F.lit("}}"))

    answered = (F.col("role") == "assistant") & (F.col("conv_id") % 4 != 0)
    lines = F.array(
        F.struct(F.lit(0).alias("at"), turn.alias("value")),
        F.struct(F.lit(3).alias("at"), F.when(answered, result("first", F.lit(False))).alias("value")),
        F.struct(F.lit(5).alias("at"), F.when(answered & (F.col("turn") % 3 == 0), result("second", F.col("turn") % 2 == 1)).alias("value")))
    return d.select("trial_path", "turn", F.inline(lines)).where("value is not null").select(
        "trial_path", (F.col("turn") * 10 + F.col("at")).cast("long").alias("line_no"), "value")


STEP_SQL = """WITH c AS (SELECT conv_id, turn, role = 'assistant' AS agent, text, conv_id % 4 <> 0 AND role = 'assistant' AS answered FROM conversations),
 s AS (SELECT conv_id, turn, 0 AS block, CASE WHEN agent THEN left(text, 300) ELSE left(text, 1000) END AS message, NULL::VARCHAR AS tool, '' AS result, NULL::BOOLEAN AS is_error FROM c WHERE trim(text) <> ''
  UNION ALL SELECT conv_id, turn, 1, '', 'Bash', CASE WHEN NOT answered THEN '' WHEN turn % 3 = 0 THEN left('second ' || text, 2000) ELSE left('first ' || text, 2000) END,
   CASE WHEN answered THEN turn % 3 = 0 AND turn % 2 = 1 END FROM c WHERE agent)
 SELECT conv_id::VARCHAR AS trial_path, row_number() OVER (PARTITION BY conv_id ORDER BY turn, block)::BIGINT AS step_idx, sha256(message) AS message, tool AS tool_name,
  sha256(result) AS result, is_error FROM s"""


@query("stream_log_steps", STEP_SQL)
def stream_log_steps(spark, sf):
    d = S.log_steps(_log_lines(spark, sf))
    return d.select("trial_path", F.col("step_idx").cast("long").alias("step_idx"), F.sha2("message", 256).alias("message"), "tool_name",
                    F.sha2("result_text", 256).alias("result"), "is_error")


@query("compact_stream_steps", r"""WITH c AS (SELECT conv_id, turn, role = 'assistant' AS agent, text, conv_id % 4 <> 0 AND role = 'assistant' AS answered FROM conversations),
 s AS (SELECT conv_id, turn * 10 AS line, 0 AS block, 'assistant_text' AS action, trim(text, E' \n\t\r') AS code FROM c WHERE agent
  UNION ALL SELECT conv_id, turn * 10, 1, 'Bash', '{"function_name":"Bash","arguments":{"command":"run step ' || turn || '"}}' FROM c WHERE agent
  UNION ALL SELECT conv_id, turn * 10 + 3, 0, 'tool_result', trim('first ' || text, E' \n\t\r') FROM c WHERE answered
  UNION ALL SELECT conv_id, turn * 10 + 5, 0, CASE WHEN turn % 2 = 1 THEN 'tool_result_error' ELSE 'tool_result' END, trim('second ' || text, E' \n\t\r') FROM c WHERE answered AND turn % 3 = 0)
 SELECT conv_id::VARCHAR AS trial_path, row_number() OVER (PARTITION BY conv_id ORDER BY line, block)::BIGINT AS step, action, sha256(left(code, 3000)) AS code FROM s WHERE code <> ''""")
def compact_stream_steps(spark, sf):
    d = S.compact_stream(_log_lines(spark, sf))
    return d.select("trial_path", F.col("step").cast("long").alias("step"), "action", F.sha2("code", 256).alias("code"))


# Ids come back every third turn, results name an id of this turn or the next: the nearest earlier call of the id is meant, its last result counts.
@query("streamed_calls", """WITH t AS (SELECT conv_id, turn, text, conv_id % 4 <> 0 AS answered FROM conversations WHERE role = 'assistant'),
 c AS (SELECT conv_id, 'u-' || turn % 3 AS id, turn * 10 AS line, 'run step ' || turn AS command FROM t),
 r AS (SELECT conv_id, 'u-' || (turn + conv_id % 2) % 3 AS id, turn * 10 + 3 AS line, left('first ' || text, 2000) AS body, false AS wrong FROM t WHERE answered
  UNION ALL SELECT conv_id, 'u-' || (turn + conv_id % 2) % 3, turn * 10 + 5, left('second ' || text, 2000), turn % 2 = 1 FROM t WHERE answered AND turn % 3 = 0),
 o AS (SELECT r.*, c.line AS call FROM r ASOF JOIN c ON r.conv_id = c.conv_id AND r.id = c.id AND r.line > c.line),
 l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY conv_id, id, call ORDER BY line DESC) = 1)
 SELECT c.conv_id::VARCHAR AS trial_path, c.id AS tool_use_id, c.line AS line_no, command, sha256(coalesce(body, '')) AS result, wrong AS is_error, body IS NOT NULL AS answered
 FROM c LEFT JOIN l ON l.conv_id = c.conv_id AND l.id = c.id AND l.call = c.line""")
def streamed_calls(spark, sf):
    """The logs as a stream: a turn's lines come in different micro-batches, some twice, and a last batch long after ends the wait."""
    use = lambda turn: F.concat(F.lit("u-"), (turn % 3).cast("string"))
    lines = _log_lines(spark, sf, use(F.col("turn")), use(F.col("turn") + F.col("conv_id") % 2))
    part = F.pmod(F.floor(F.col("line_no") / 10) + F.col("line_no") % 10, F.lit(3))
    at = lambda hour: F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hour))
    end = spark.createDataFrame([("end", 0, '{"type":"tool_result","tool_use_id":"none","message":{"content":""}}')], "trial_path string, line_no long, value string")
    folder = shared_folder(spark, "calls")
    batches = [lines.where(part == 0), lines.where((part == 1) | ((part == 0) & (F.col("line_no") % 10 == 3))), lines.where(part == 2), end]
    for k, batch in enumerate(batches):
        batch.withColumn("arrived", at(k if k < 3 else 100)).write.mode("append").parquet(f"{folder}/lines")
        stream = spark.readStream.schema("trial_path string, line_no long, value string, arrived timestamp").parquet(f"{folder}/lines")
        ST.ingest_calls(stream, f"{folder}/store", f"{folder}/offsets", "12 hours", 8).awaitTermination()
    d = read_store(spark, f"{folder}/store")
    return d.select("trial_path", "tool_use_id", "line_no", F.col("args")["command"].alias("command"), F.sha2("result_text", 256).alias("result"), "is_error", "answered")


@query("result_texts", """WITH o AS (SELECT o_orderkey AS k, o_comment_ AS c, o_orderkey % 5 AS m FROM (SELECT *, o_orderpriority || ' ' || o_orderstatus AS o_comment_ FROM orders))
 SELECT k AS o_orderkey, CASE WHEN m = 0 THEN 'cut ' || c WHEN m = 1 THEN c WHEN m = 2 THEN 'raw ' || c WHEN m = 3 THEN 'out ' || c || chr(10) || 'err' ELSE '' END AS result FROM o""")
def result_texts(spark, sf):
    o = table(spark, sf, "orders")
    m, c = F.col("o_orderkey") % 5, F.concat("o_orderpriority", F.lit(" "), "o_orderstatus")
    pick = lambda n, v: F.when(m == n, v)
    text = E.result_text(pick(0, F.concat(F.lit("cut "), c)), F.when(m <= 1, c).otherwise(""), pick(2, F.concat(F.lit("raw "), c)),
                         F.when(m <= 3, F.concat(F.lit("out "), c)), F.when(m <= 3, F.lit("err")))
    return o.select("o_orderkey", text.alias("result"))


@query("assessed_clusters", """SELECT 'c-' || p_partkey AS capability_id, p_brand FROM part WHERE p_size % 3 = 0 AND p_partkey % 10 >= 7""")
def assessed_clusters(spark, sf):
    """C3 with an assessment table: low, missing and unsure assessments do not pass; repeated ones count once."""
    p = table(spark, sf, "part")
    name = F.concat(F.lit("c-"), F.col("p_partkey").cast("string"))
    rows = p.select(name.alias("cluster_id"), F.when(F.col("p_size") % 3 == 0, "high").when(F.col("p_size") % 3 == 1, "low").alias("quality"),
                    F.when(F.col("p_partkey") % 10 > 0, (F.col("p_partkey") % 10) / 10).alias("confidence"))
    return CL.quality_gate(p.select(name.alias("capability_id"), "p_brand"), rows.unionByName(rows.where("confidence > 0.8")))
