"""Trajectory queries over the step view of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import commands as C
from ..functions import errors as E
from ..functions import text as T
from ..operators import retry as R
from ..operators import sampling as S
from ..operators import trajectory as TR
from . import evidence as EV
from . import views as V
from .catalog import query

A = V.ATT
join = lambda c, sep="|": F.array_join(c, sep)


def W(*ctes: str, body: str) -> str:
    return f"WITH {V.merge_ctes(*ctes)}\n{body}"


# --- fixed SQL twins of the classifiers -----------------------------------------------------

def sql_candidate_error(c: str) -> str:
    return f"""CASE WHEN regexp_matches(lower({c}), 'syntax|indentation') THEN 'syntax'
 WHEN regexp_matches(lower({c}), 'timeout|connection|\\b50[234]\\b') THEN 'transient'
 WHEN regexp_matches(lower({c}), 'no such file|filenotfound') THEN 'missing_file'
 WHEN regexp_matches(lower({c}), 'modulenotfounderror|importerror|command not found') THEN 'not_found'
 WHEN regexp_matches(lower({c}), 'schema|layout|merged|encoding|file format|binary file|cannot read binary|text-only|unsupported format') THEN 'data_obstacle'
 WHEN regexp_matches(lower({c}), 'assert|failed') THEN 'validation'
 WHEN contains(lower({c}), 'permission') THEN 'permission' WHEN {c} <> '' THEN 'runtime' ELSE 'unknown' END"""


def sql_trace_error(c: str) -> str:
    return f"""CASE WHEN regexp_matches(lower({c}), 'traceback|syntaxerror|indentationerror') THEN 'syntax'
 WHEN regexp_matches(lower({c}), 'modulenotfounderror|importerror|command not found') THEN 'not_found'
 WHEN regexp_matches(lower({c}), 'keyerror|attributeerror|typeerror|valueerror') THEN 'runtime'
 WHEN regexp_matches(lower({c}), 'assert|fail') THEN 'assertion'
 WHEN regexp_matches(lower({c}), 'permission denied|access denied') THEN 'permission'
 WHEN regexp_matches(lower({c}), 'filenotfounderror|no such file') THEN 'missing_file'
 WHEN regexp_matches(lower({c}), 'exit code[:\\s]*0*[1-9]') THEN 'non_zero_exit' ELSE 'unknown' END"""


TEXT = "trim(CASE WHEN command <> '' THEN command ELSE description END)"
SQL_SHAPE = (f"left(regexp_replace(regexp_replace(regexp_replace(lower({TEXT}), '[/\\\\][\\w./\\\\-]+', '<path>', 'g'), "
             f"'\\b\\d+(?:\\.\\d+)?\\b', '<num>', 'g'), '\\s+', ' ', 'g'), 240)")
SPANS_SQL = V.merge_ctes(V.CALLS_SQL, f"""
closers AS (SELECT *, {TEXT} AS txt, success AND split_part(lower({TEXT}), ' ', 1) NOT IN ('ls','pwd','cd','echo','cat','head','tail','mkdir') AS is_closer FROM calls),
numbered AS (SELECT *, coalesce(sum(CAST(is_closer AS INTEGER)) OVER (PARTITION BY {A} ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM closers),
members AS (SELECT *, {SQL_SHAPE} AS shape, {sql_candidate_error("error_message")} AS etype FROM numbered WHERE NOT success OR is_closer),
spans AS (
  SELECT {A}, CAST(span AS BIGINT) AS span, count(*) FILTER (NOT success) AS failures,
         count(DISTINCT (lower(tool_name), shape, etype)) FILTER (NOT success) AS distinct_failures,
         list_sort(list(DISTINCT etype) FILTER (NOT success)) AS error_types, min(step_idx) FILTER (NOT success) AS first_step,
         coalesce(max(step_idx) FILTER (is_closer), max(step_idx) FILTER (NOT success)) AS last_step,
         count(*) FILTER (is_closer) > 0 AS resolved, coalesce(max(tool_name) FILTER (is_closer), '') AS winning_tool,
         coalesce(max(txt) FILTER (is_closer), '') AS winning_command,
         list(trim(regexp_replace(lower(txt), '\\s+', ' ', 'g'))) FILTER (NOT success) AS failed_commands
  FROM members GROUP BY {A}, span HAVING count(*) FILTER (NOT success) > 0)""")
CANDIDATES_SQL = V.merge_ctes(SPANS_SQL, V.ATTEMPTS_SQL, f"""
span_candidates AS (
  SELECT s.task_name || ':' || s.attempt_number || ':span-' || span AS candidate_id, s.task_family, s.task_name, s.attempt_number,
         first_step, last_step, winning_tool, winning_command, distinct_failures + CAST(resolved AS INTEGER) AS exploration_cost,
         'resolve processing obstacle with ' || CASE WHEN winning_tool <> '' THEN winning_tool ELSE 'an alternative approach' END AS intent,
         array_to_string(error_types, '; ') AS obstacle,
         CASE WHEN resolved THEN 'Use the verified ' || winning_tool || ' approach and validate its output.'
              ELSE 'Investigate the obstacle before committing to an implementation.' END AS resolution,
         CASE WHEN verifier_passed THEN 'verified_success' WHEN resolved THEN 'tool_recovery' ELSE 'unresolved_failure' END AS evidence_label,
         'trajectory' AS evidence_source, CAST(NULL AS VARCHAR) AS retry_outcome, 'recovery_candidate' AS candidate_kind
  FROM spans s JOIN attempts a USING ({A})
  WHERE distinct_failures + CAST(resolved AS INTEGER) >= CASE WHEN resolved THEN 2 ELSE 1 END
    AND len(list_filter(error_types, lambda e: e NOT IN ('syntax','transient','runtime','unknown'))) > 0
    AND NOT (resolved AND list_contains(failed_commands, lower(winning_command))))""")


@query("step_view", f"WITH {V.STEPS_SQL} SELECT {A}, step_idx, source, message, tool_name, result_text FROM steps")
def step_view(spark, sf):
    return V.steps(spark, sf).select(*TR.ATTEMPT, "step_idx", "source", "message", "tool_name", "result_text")


@query("tool_calls", f"""WITH {V.CALLS_SQL}
SELECT {A}, step_idx, tool_name, command, description, array_to_string(input_files, '|') AS inputs,
       array_to_string(output_files, '|') AS outputs, success, error_message FROM calls""")
def tool_calls(spark, sf):
    return V.calls(spark, sf).select(*TR.ATTEMPT, "step_idx", "tool_name", "command", "description",
                                     join("input_files").alias("inputs"), join("output_files").alias("outputs"),
                                     "success", "error_message")


@query("error_events", f"""WITH {V.CALLS_SQL}
SELECT {A}, step_idx, tool_name, error_message, {sql_trace_error("error_message")} AS error_type FROM calls WHERE NOT success""")
def error_events(spark, sf):
    return TR.error_events(V.calls(spark, sf))


@query("error_labels", f"""WITH {V.CALLS_SQL}
SELECT {sql_trace_error("error_message")} AS trace_label, {sql_candidate_error("error_message")} AS candidate_label,
       count(*) AS n FROM calls WHERE NOT success GROUP BY ALL""")
def error_labels(spark, sf):
    m = F.col("error_message")
    return V.calls(spark, sf).filter(~F.col("success")).groupBy(
        E.trace_error_type(m).alias("trace_label"), E.candidate_error_type(m).alias("candidate_label")).agg(
        F.count(F.lit(1)).alias("n"))


SUFFIX = lambda p: f"lower(regexp_extract({p}, '[^/]\\.([^./]+)$', 1))"
SQL_TARGET = lambda paths, fb: f"""CASE WHEN len(list_filter(list_transform({paths}, lambda p: {SUFFIX('p')}), lambda s: s <> '')) > 0
 THEN '*.' || list_filter(list_transform({paths}, lambda p: {SUFFIX('p')}), lambda s: s <> '')[1]
 WHEN len({paths}) > 0 THEN left(lower(regexp_extract({paths}[1], '([^/]+)/*$', 1)), 80)
 ELSE nullif(left(regexp_replace(regexp_replace(regexp_replace(lower(trim({fb})), '[''\\"][^''\\"]{{1,120}}[''\\"]', '<quoted>', 'g'), '\\b\\d+\\b', '<num>', 'g'), '\\s+', ' ', 'g'), 80), '') END"""  # noqa: E731
EVENTS_SQL = V.merge_ctes(V.CALLS_SQL, f"""
acts AS (
  SELECT c.*, {V.sql_paths("command")} AS cmd_paths, {V.sql_written("command")} AS cmd_written, lower(trim(command)) AS low,
    CASE WHEN tool_name = 'Read' THEN 'read_file' WHEN tool_name = 'Edit' THEN 'edit_file' WHEN tool_name = 'Write' THEN 'write_file'
    WHEN regexp_matches(lower(command), '(^|[;&|]\\s*)(rg|grep|find)\\b') THEN 'search_text'
    WHEN split_part(lower(command), ' ', 1) IN ('cat','less','more','head','tail','nl') THEN 'read_file'
    WHEN regexp_matches(lower(command), '\\b(openpyxl|xlrd|xlwt|xlwings|xlsxwriter)\\b') THEN
         CASE WHEN len({V.sql_written("command")}) > 0 THEN 'write_spreadsheet' ELSE 'read_spreadsheet' END
    WHEN regexp_matches(lower(command), '\\b(pdfplumber|pypdf|pdfminer|fitz\\b|pikepdf|camelot)\\b') THEN 'extract_pdf'
    WHEN regexp_matches(lower(command), '\\bjson\\.(dump|dumps)\\b') THEN 'write_json'
    WHEN regexp_matches(lower(command), '\\bjson\\.(load|loads)\\b') THEN 'read_json'
    WHEN regexp_matches(lower(command), '\\bpd\\.read_\\w+\\b') THEN 'read_dataframe'
    WHEN regexp_matches(lower(command), '\\bpd\\.to_\\w+\\b|\\.to_csv\\(|\\.to_excel\\(|\\.to_json\\(|\\.to_parquet\\(') THEN 'write_dataframe'
    WHEN contains(lower(command), 'apply_patch') OR regexp_matches(lower(command), '(?s)(^|[;&|]\\s*)(python|python3)\\b.*\\b(write_text|write_bytes|open\\()') THEN 'edit_file'
    WHEN len({V.sql_written("command")}) > 0 THEN 'write_file'
    WHEN regexp_matches(lower(command), '(^|[;&|]\\s*)(pytest|python\\s+-m\\s+pytest|npm\\s+test)\\b') THEN 'run_test'
    WHEN regexp_matches(lower(command), '(^|[;&|]\\s*)(git\\s+diff|git\\s+status|git\\s+show)\\b') THEN 'inspect_state'
    WHEN regexp_matches(lower(command), 'traceback|failed|error|assert') THEN 'inspect_failure'
    WHEN regexp_matches(lower(command), '\\b(requests\\.\\w+|urllib\\.request|httpx\\.\\w+|curl\\b)') THEN 'http_request'
    ELSE 'other_command' END AS act0
  FROM calls c),
acts2 AS (
  SELECT *, CASE WHEN tool_name IN ('Edit', 'Write') THEN {SQL_TARGET("(CASE WHEN len(output_files) > 0 THEN output_files ELSE input_files END)", "description")}
    WHEN tool_name = 'Read' THEN {SQL_TARGET("input_files", "description")}
    WHEN act0 IN ('write_spreadsheet', 'write_file') THEN {SQL_TARGET("cmd_written", "low")}
    WHEN act0 = 'other_command' AND len(cmd_paths) = 0 THEN NULL
    WHEN act0 = 'other_command' THEN {SQL_TARGET("cmd_paths", "description")}
    ELSE {SQL_TARGET("cmd_paths", "low")} END AS target,
    CASE WHEN NOT success AND act0 IN ('other_command', 'other_tool') THEN 'inspect_failure' ELSE act0 END AS action,
    left(CASE WHEN command <> '' THEN command ELSE description END, 1000) AS raw_text
  FROM acts),
events_norm AS (
  SELECT *, action || ':' || coalesce(target, 'any') AS signature_token,
    CASE WHEN error_message <> '' THEN {sql_trace_error("error_message")} ELSE '' END AS error_type,
    round(CASE action WHEN 'search_text' THEN 0.8 WHEN 'read_file' THEN 0.6 WHEN 'edit_file' THEN 1.2 WHEN 'write_file' THEN 1.1
      WHEN 'run_test' THEN 1.4 WHEN 'inspect_failure' THEN 0.9 WHEN 'inspect_state' THEN 0.5 WHEN 'read_spreadsheet' THEN 0.9
      WHEN 'write_spreadsheet' THEN 1.2 WHEN 'extract_pdf' THEN 1.0 WHEN 'read_json' THEN 0.6 WHEN 'write_json' THEN 0.9
      WHEN 'read_dataframe' THEN 0.8 WHEN 'write_dataframe' THEN 1.0 WHEN 'http_request' THEN 0.7 ELSE 0.4 END
      + CASE WHEN success THEN 0.0 ELSE 0.8 END, 2)::DOUBLE AS cost
  FROM acts2)""")


@query("normalized_events", f"WITH {EVENTS_SQL} SELECT {A}, step_idx, action, target, signature_token, success, error_type, cost FROM events_norm")
def normalized_events(spark, sf):
    return TR.normalized_events(V.calls(spark, sf)).select(
        *TR.ATTEMPT, "step_idx", "action", "target", "signature_token", "success", "error_type", F.round("cost", 2).alias("cost"))


# RE2 has no back reference: each quote kind is one alternative.
_ART = "\\.(?:xlsx?|csv|tsv|jsonl?|pdf|docx?|py|txt|ya?ml|xml)"
SQL_CMD_SHAPE = lambda c: (
    "left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(" + c + "), "
    f"'(?i)''[^''\"]+{_ART}''|\"[^''\"]+{_ART}\"', '<artifact>', 'g'), '(?:^|[\\s=(])(/[^\\s''\")]+)', ' <path>', 'g'), "
    "'\\b[A-Z]{2,}[A-Z0-9_-]*\\d{3,}\\b', '<id>', 'g'), '\\b\\d+(?:\\.\\d+)?\\b', '<num>', 'g'), '\\s+', ' ', 'g')), 320)")


@query("command_shapes", f"""WITH {V.CALLS_SQL}
SELECT {SQL_CMD_SHAPE(TEXT)} AS command_shape, {SQL_SHAPE} AS attempt_shape, count(*) AS n FROM calls GROUP BY ALL""")
def command_shapes(spark, sf):
    shape = C.attempt_shape(F.col("tool_name"), F.col("command"), F.col("description"), F.col("error_message"))["command"]
    return V.calls(spark, sf).groupBy(
        C.command_shape(C.call_text(F.col("command"), F.col("description"))).alias("command_shape"), shape.alias("attempt_shape")).agg(
        F.count(F.lit(1)).alias("n"))


@query("failure_spans", f"""WITH {SPANS_SQL}
SELECT {A}, span, failures, distinct_failures, array_to_string(error_types, '; ') AS error_types, first_step, last_step,
       resolved, winning_tool, winning_command, resolved AND list_contains(failed_commands, lower(winning_command)) AS winner_was_tried FROM spans""")
def failure_spans(spark, sf):
    d = TR.failure_spans(V.calls(spark, sf))
    return d.withColumn("error_types", F.array_join("error_types", "; ")).withColumn("span", F.col("span").cast("long"))


@query("span_candidates", f"WITH {CANDIDATES_SQL} SELECT * FROM span_candidates")
def span_candidates(spark, sf):
    return TR.span_candidates(V.calls(spark, sf), V.attempts(spark, sf))


@query("span_resolution_report", f"""WITH {CANDIDATES_SQL}
SELECT evidence_label, winning_tool, count(*) AS candidates, sum(exploration_cost)::BIGINT AS total_cost, max(exploration_cost) AS max_cost
FROM span_candidates GROUP BY ALL""")
def span_resolution_report(spark, sf):
    return TR.span_candidates(V.calls(spark, sf), V.attempts(spark, sf)).groupBy("evidence_label", "winning_tool").agg(
        F.count(F.lit(1)).alias("candidates"), F.sum("exploration_cost").alias("total_cost"), F.max("exploration_cost").alias("max_cost"))


@query("thinking_segments", f"""WITH {V.STEPS_SQL},
marked AS (SELECT *, sum(CASE WHEN tool_name IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY {A} ORDER BY step_idx) AS island,
                  max(step_idx) OVER (PARTITION BY {A}) AS total FROM steps),
isl AS (SELECT {A}, island, min(step_idx) FILTER (tool_name IS NULL AND source = 'agent') AS start_step, max(step_idx) AS end_step,
               left(coalesce(string_agg(message, ' ' ORDER BY step_idx) FILTER (tool_name IS NULL AND source = 'agent' AND message <> ''), ''), 2000) AS text
        FROM marked GROUP BY {A}, island)
SELECT {A}, start_step, end_step, text,
  regexp_matches(lower(text), 'retry|try again|again|fix|correct|adjust|update|verify|double-check|re-run|rerun|instead|revise|alternative|different approach|let me try|should have|failed because|error was|the issue is|need to') AS suggests_retry,
  regexp_matches(lower(text), 'fix|correct|adjust|debug') AS mentions_fix,
  regexp_matches(lower(text), 'alternative|instead|rather than|different approach|another way|switch to|use.*instead') AS mentions_alternative
FROM isl WHERE start_step IS NOT NULL""")
def thinking_segments(spark, sf):
    return TR.thinking_segments(V.steps(spark, sf))


@query("conversation_segments", """WITH s AS (
  SELECT conv_id, turn + 1 AS step_idx, text, role = 'assistant' AS is_agent FROM conversations)
SELECT conv_id::VARCHAR AS task_name, min(step_idx) FILTER (is_agent) AS start_step, max(step_idx) AS end_step,
       left(coalesce(string_agg(trim(text, E' \\n\\t\\r'), ' ' ORDER BY step_idx) FILTER (is_agent), ''), 2000) AS text
FROM s GROUP BY conv_id HAVING count(*) FILTER (is_agent) > 0""")
def conversation_segments(spark, sf):
    d = V.table(spark, sf, "conversations").select(
        F.lit("chat").alias("task_family"), F.col("conv_id").cast("string").alias("task_name"), F.lit(1).alias("attempt_number"),
        (F.col("turn") + 1).alias("step_idx"), F.when(F.col("role") == "assistant", "agent").otherwise("user").alias("source"),
        F.col("text").alias("message"), F.lit(None).cast("string").alias("tool_name"))
    return TR.thinking_segments(d).select("task_name", "start_step", "end_step", "text")


TOUCH_SQL = V.merge_ctes(V.CALLS_SQL, f"""
raw_touch AS (SELECT {A}, step_idx, unnest({V.sql_distinct("list_concat(input_files, output_files)")}) AS path,
                     generate_subscripts({V.sql_distinct("list_concat(input_files, output_files)")}, 1) AS pos, input_files, output_files FROM calls),
touch AS (SELECT {A}, step_idx, path, pos, lower(regexp_extract(path, '([^/]+)/*$', 1)) AS artifact,
                 list_contains(output_files, path) AS produced, list_contains(input_files, path) AS consumed FROM raw_touch)""")


@query("artifact_touches", f"WITH {TOUCH_SQL} SELECT {A}, artifact, path, step_idx, produced, consumed FROM touch")
def artifact_touches(spark, sf):
    return TR.artifact_touches(V.calls(spark, sf)).drop("_pos")


@query("artifacts", f"""WITH {TOUCH_SQL}
SELECT {A}, artifact, arg_min(path, (step_idx, pos)) AS path, min(step_idx) AS first_step, max(step_idx) AS last_step,
  count(*) FILTER (produced) AS times_produced, count(*) FILTER (consumed) AS times_consumed,
  {SUFFIX("arg_min(path, (step_idx, pos))")} AS ext,
  CASE WHEN bool_or(produced) AND NOT bool_or(consumed) THEN 'output' WHEN bool_or(consumed) AND NOT bool_or(produced) THEN 'input' ELSE 'intermediate' END AS role
FROM touch GROUP BY {A}, artifact""")
def artifacts(spark, sf):
    return TR.artifacts(V.calls(spark, sf))


@query("artifact_revisits", f"""WITH {TOUCH_SQL}
SELECT {A}, artifact, count(DISTINCT step_idx) AS touches FROM touch GROUP BY {A}, artifact HAVING count(DISTINCT step_idx) >= 2""")
def artifact_revisits(spark, sf):
    return TR.artifact_revisits(V.calls(spark, sf))


SQL_EXTS = lambda l: f"list_sort(list_distinct(list_filter(list_transform({l}, lambda p: {SUFFIX('p')}), lambda s: s <> '')))"
ATOMS_SQL = V.merge_ctes(EVENTS_SQL, f"""
atoms AS (SELECT {A}, step_idx, action, tool_name, target,
  action || ':' || coalesce(target, 'any') || ':' || array_to_string({SQL_EXTS("input_files")}, ',') || '->' || array_to_string({SQL_EXTS("output_files")}, ',') AS signature,
  {SQL_CMD_SHAPE("CASE WHEN command <> '' THEN command ELSE description END")} AS command_shape
  FROM events_norm WHERE success AND action NOT IN ('other_command', 'other_tool')),
nexts AS (SELECT *, lead(step_idx) OVER w AS r_step, lead(action) OVER w AS r_action, lead(tool_name) OVER w AS r_tool,
                 lead(target) OVER w AS r_target, lead(signature) OVER w AS r_signature, lead(command_shape) OVER w AS r_shape
          FROM atoms WINDOW w AS (PARTITION BY {A} ORDER BY step_idx)),
bigrams AS (SELECT {A}, step_idx AS first_step, r_step AS last_step, action || ' -> ' || r_action AS action, tool_name || '+' || r_tool AS tool_name,
  coalesce(r_target, target) AS target, 'workflow:' || signature || '->' || r_signature AS signature, command_shape || ' -> ' || r_shape AS command_shape
  FROM nexts WHERE r_step - step_idx <= 4 AND r_action <> action),
subs AS (SELECT {A}, 'atomic' AS kind, step_idx AS first_step, step_idx AS last_step, action, tool_name, target, signature, command_shape FROM atoms
  UNION ALL SELECT {A}, 'workflow', first_step, last_step, action, tool_name, target, signature, command_shape FROM bigrams)""")


@query("atomic_substeps", f"WITH {ATOMS_SQL} SELECT {A}, step_idx, action, tool_name, target, signature, command_shape FROM atoms")
def atomic_substeps(spark, sf):
    return TR.atomic_substeps(TR.normalized_events(V.calls(spark, sf))).drop("input_formats", "output_formats")


@query("workflow_bigrams", f"WITH {ATOMS_SQL} SELECT * FROM bigrams")
def workflow_bigrams(spark, sf):
    return TR.workflow_bigrams(TR.atomic_substeps(TR.normalized_events(V.calls(spark, sf)))).drop("input_formats", "output_formats")


@query("public_actions", f"""WITH {ATOMS_SQL}
SELECT action, len(list_filter(string_split(action, '->'), lambda x: trim(x) IN ('read_file','write_file','edit_file','read_json','write_json','search_text','run_test','inspect_state','inspect_failure'))) = 0 AS is_public,
       count(*) AS n FROM subs GROUP BY ALL""")
def public_actions(spark, sf):
    subs = TR.substeps(TR.normalized_events(V.calls(spark, sf)))
    return subs.groupBy("action").agg(F.count(F.lit(1)).alias("n")).select(
        "action", C.is_public_action(F.col("action")).alias("is_public"), "n")


UNIQUE_SQL = V.merge_ctes(ATOMS_SQL, V.ATTEMPTS_SQL, f"""
unique_subs AS (SELECT * FROM subs JOIN (SELECT {A} FROM attempts WHERE verifier_passed) p USING ({A})
  QUALIFY row_number() OVER (PARTITION BY task_name, signature ORDER BY attempt_number, kind, first_step) = 1)""")


@query("distinct_substeps", f"WITH {UNIQUE_SQL} SELECT {A}, kind, first_step, last_step, action, tool_name, target, signature, command_shape FROM unique_subs")
def distinct_substeps(spark, sf):
    subs = TR.substeps(TR.normalized_events(V.calls(spark, sf)))
    return TR.distinct_substeps(subs, V.attempts(spark, sf)).drop("input_formats", "output_formats")


LAST_SQL = V.merge_ctes(V.CALLS_SQL, V.ATTEMPTS_SQL, f"""
lastf AS (SELECT {A}, step_idx, tool_name, {TEXT} AS command, error_message, {sql_candidate_error("error_message")} AS error_type
  FROM calls JOIN (SELECT {A} FROM attempts WHERE NOT verifier_passed) r USING ({A}) WHERE NOT success
  QUALIFY row_number() OVER (PARTITION BY {A} ORDER BY step_idx DESC) <= 3),
last_failures AS (SELECT * FROM lastf UNION ALL
  SELECT {A}, 0, 'verifier', 'final artifact verification', 'final verifier rejected the artifact', 'validation'
  FROM attempts a WHERE NOT verifier_passed AND NOT EXISTS (SELECT 1 FROM lastf l WHERE l.task_name = a.task_name AND l.attempt_number = a.attempt_number))""")


@query("last_failures", f"WITH {LAST_SQL} SELECT * FROM last_failures")
def last_failures(spark, sf):
    rejected = V.attempts(spark, sf).filter(~F.col("verifier_passed"))
    return TR.last_failures(V.calls(spark, sf), rejected, "final verifier rejected the artifact")


# --- retries --------------------------------------------------------------------------------

LINKS_SQL = V.merge_ctes(V.ATTEMPTS_SQL, f"""
links AS (SELECT a.*, b.verifier_passed AS retry_passed,
    CASE WHEN b.task_name IS NULL THEN 'missing' WHEN b.verifier_passed THEN 'success' ELSE 'failure' END AS retry_outcome
  FROM attempts a LEFT JOIN attempts b ON a.task_name = b.task_name AND b.attempt_number = a.attempt_number + 1
  WHERE a.reflection <> '')""")


@query("retry_links", f"WITH {LINKS_SQL} SELECT {A}, retry_outcome, retry_outcome = 'success' AS verified_by_retry FROM links")
def retry_links(spark, sf):
    return R.retry_links(V.attempts(spark, sf)).select(*TR.ATTEMPT, "retry_outcome", "verified_by_retry")


def ops_sql(first_operations: str = "", first_changes: str = "") -> str:
    """Operations of both sides and their changes; all of them, or those that the two clauses choose."""
    return V.merge_ctes(EVENTS_SQL, LINKS_SQL, f"""
ops0 AS (SELECT {A}, step_idx, left(signature_token || ' [' || CASE WHEN success THEN 'succeeded' ELSE 'failed' END || ']'
     || CASE WHEN {SQL_CMD_SHAPE("raw_text")} <> '' THEN ' ' || {SQL_CMD_SHAPE("raw_text")} ELSE '' END, 500) AS operation FROM events_norm{first_operations}),
ops AS (SELECT *, row_number() OVER (PARTITION BY {A} ORDER BY step_idx) AS pos,
     row_number() OVER (PARTITION BY {A}, operation ORDER BY step_idx) AS cpy FROM ops0),
src AS (SELECT o.* FROM ops o JOIN links l USING ({A}) WHERE retry_outcome <> 'missing'),
ret AS (SELECT o.task_family, o.task_name, o.attempt_number - 1 AS attempt_number, o.operation, o.pos, o.cpy FROM ops o
     JOIN links l ON o.task_name = l.task_name AND o.attempt_number - 1 = l.attempt_number WHERE retry_outcome <> 'missing'),
both_sides AS (SELECT coalesce(s.task_family, r.task_family) AS task_family, coalesce(s.task_name, r.task_name) AS task_name,
     coalesce(s.attempt_number, r.attempt_number) AS attempt_number, coalesce(s.operation, r.operation) AS operation,
     CASE WHEN s.pos IS NULL THEN 'added' WHEN r.pos IS NULL THEN 'removed' ELSE 'retained' END AS change, coalesce(r.pos, s.pos) AS pos
  FROM src s FULL JOIN ret r ON s.task_name = r.task_name AND s.attempt_number = r.attempt_number AND s.operation = r.operation AND s.cpy = r.cpy),
changes AS (SELECT {A}, change, operation, row_number() OVER (PARTITION BY {A}, change ORDER BY pos) AS rank FROM both_sides{first_changes})""")


@query("retry_changes", f"WITH {ops_sql()} SELECT * FROM changes")
def retry_changes(spark, sf):
    events = TR.normalized_events(V.calls(spark, sf))
    return R.retry_changes(events, R.retry_links(V.attempts(spark, sf)), max_operations=None, max_changes=None)


BOUNDED_OPS_SQL = ops_sql(f"""
  QUALIFY row_number() OVER (PARTITION BY {A} ORDER BY step_idx) <= 60""", f"""
  QUALIFY row_number() OVER (PARTITION BY {A}, change ORDER BY pos) <= 30""")


@query("retry_transitions", f"""WITH {BOUNDED_OPS_SQL},
agg AS (SELECT {A}, string_agg(operation, ' | ' ORDER BY rank) FILTER (change = 'added') AS added,
   string_agg(operation, ' | ' ORDER BY rank) FILTER (change = 'removed') AS removed,
   string_agg(operation, ' | ' ORDER BY rank) FILTER (change = 'retained') AS retained FROM changes GROUP BY {A})
SELECT {A}, l.attempt_number + 1 AS to_attempt, retry_outcome, retry_passed, coalesce(added, '') AS added, coalesce(removed, '') AS removed,
  coalesce(retained, '') AS retained, retry_outcome = 'missing' AS artifact_missing FROM links l LEFT JOIN agg USING ({A})""")
def retry_transitions(spark, sf):
    events = TR.normalized_events(V.calls(spark, sf))
    d = R.retry_transitions(events, R.retry_links(V.attempts(spark, sf)))
    return d.select(*TR.ATTEMPT, "to_attempt", "retry_outcome", "retry_passed", "artifact_missing",
                    *[join(f"{k}_operations", " | ").alias(k) for k in ("added", "removed", "retained")])


@query("retry_episodes", f"""WITH {LINKS_SQL},
t AS (SELECT task_name, bool_or(verifier_passed) AS final_success, count(*) AS attempts FROM attempts GROUP BY task_name HAVING bool_or(reflection <> ''))
SELECT a.task_family, task_name, a.attempt_number, a.verifier_passed, final_success, t.attempts, l.retry_outcome
FROM attempts a JOIN t USING (task_name) LEFT JOIN (SELECT task_name, attempt_number, retry_outcome FROM links) l USING (task_name, attempt_number)""")
def retry_episodes(spark, sf):
    a = V.attempts(spark, sf)
    return R.retry_episodes(a, R.retry_links(a))


def sql_field(h: str) -> str:
    return f"trim(regexp_replace(regexp_extract(reflection, '{h}: ((?:[^\\n]|\\n  )*)', 1), '\\s+', ' ', 'g'))"


def sql_param(c: str) -> str:
    # No quoted paths or cells touch word characters in these texts, so plain alternation is enough.
    return (f"trim(regexp_replace(regexp_replace(regexp_replace({c}, '(^|\\s)/(?:[^\\s]+/)+[^\\s]+', '\\1[redacted path]', 'g'), "
            f"'(?i)\\b[a-z]{{1,3}}\\d+\\b', '<cell>', 'g'), '\\b\\d+(?:\\.\\d+)?\\b', '<num>', 'g'))")


REFLECTION_SQL = V.merge_ctes(LINKS_SQL, f"""
refl AS (SELECT {A}, retry_outcome, {sql_field("FAILURE OBSERVABLE")} AS observable, {sql_field("ROOT CAUSE")} AS root_cause,
                {sql_field("CORRECTIVE ACTION")} AS corrective FROM links)""")


@query("reflection_fields", f"""WITH {REFLECTION_SQL}
SELECT {A}, observable, root_cause, corrective, '' AS missing FROM refl""")
def reflection_fields(spark, sf):
    d = R.retry_links(V.attempts(spark, sf)).withColumn("f", T.reflection_fields(F.col("reflection")))
    return d.select(*TR.ATTEMPT, "f.observable", "f.root_cause", "f.corrective", "f.missing")


@query("reflection_candidates", f"""WITH {REFLECTION_SQL}
SELECT {A}, {sql_param("observable")} AS intent, {sql_param("root_cause")} AS obstacle, {sql_param("corrective")} AS resolution,
  CASE WHEN retry_outcome = 'success' THEN 'verified_success' ELSE 'unresolved_failure' END AS evidence_label, retry_outcome FROM refl""")
def reflection_candidates(spark, sf):
    return R.reflection_candidates(V.calls(spark, sf), R.retry_links(V.attempts(spark, sf))).select(
        *TR.ATTEMPT, "intent", "obstacle", "resolution", "evidence_label", "retry_outcome")


def all_candidates(spark, sf):
    """K4: spans, reflections, substeps of passing attempts and final rejections."""
    return EV.extract(V.steps(spark, sf), V.attempts(spark, sf)).candidates


KINDS_SQL = V.merge_ctes(CANDIDATES_SQL, UNIQUE_SQL, LINKS_SQL, f"""
kinds AS (
  SELECT candidate_kind, evidence_source, evidence_label, {A} FROM span_candidates
  UNION ALL SELECT 'recovery_candidate', 'reflection', CASE WHEN retry_outcome = 'success' THEN 'verified_success' ELSE 'unresolved_failure' END, {A} FROM links
  UNION ALL SELECT CASE WHEN kind = 'workflow' THEN 'workflow' ELSE 'atomic_substep' END, 'trajectory', 'verified_success', {A} FROM unique_subs
  UNION ALL SELECT 'recovery_candidate', 'trajectory', 'unresolved_failure', {A} FROM attempts WHERE NOT verifier_passed)""")


@query("candidate_union", f"""WITH {KINDS_SQL}
SELECT candidate_kind, evidence_source, evidence_label, {A}, count(*) AS candidates FROM kinds GROUP BY ALL""")
def candidate_union(spark, sf):
    """Candidates of each attempt and kind."""
    return all_candidates(spark, sf).groupBy("candidate_kind", "evidence_source", "evidence_label", *TR.ATTEMPT).agg(F.count(F.lit(1)).alias("candidates"))


# --- evidence steps -------------------------------------------------------------------------

@query("compact_steps", """SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'thinking' WHEN 'user' THEN 'user_prompt' END AS type,
       left(text, 300) AS text FROM conversations WHERE role = 'user' OR (role = 'assistant' AND trim(text) <> '')""")
def compact_steps(spark, sf):
    d = V.table(spark, sf, "conversations")
    none = F.lit(None).cast("string")
    source = F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role"))
    return d.withColumn("c", T.compact_step(source, F.col("text"), none, none, none)).filter("c is not null").select(
        "conv_id", "turn", "c.type", "c.text")


def evidence_steps(spark, sf):
    """All steps of a task as one long trajectory with an action and a text."""
    d = V.numbered(V._event_base(spark, sf), ["task_name"], ["ts", "event_id"], "step", F.to_date("ts"))
    action = F.when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "signup", "assistant_text").otherwise("read")
    code = F.when(F.col("event_type") == "error", V._pick(V.ERRORS, F.col("k"))).otherwise(F.concat(F.lit("step "), F.col("k").cast("string")))
    return d.select("task_name", "step", action.alias("action"), code.alias("code"))


def _sample_sql(budget: int, head: int, tail: int) -> str:
    return f"""WITH {V.EVENTS_SQL},
s AS (SELECT task_name, row_number() OVER (PARTITION BY task_name ORDER BY ts, event_id) AS step, count(*) OVER (PARTITION BY task_name) AS n,
   CASE event_type WHEN 'purchase' THEN 'write' WHEN 'signup' THEN 'assistant_text' ELSE 'read' END AS action,
   CASE WHEN event_type = 'error' THEN {V._sql_pick(V.ERRORS)} ELSE 'step ' || k END AS code FROM ev),
f AS (SELECT *, step <= {head} OR step > n - {tail} AS is_end, action = 'write' OR regexp_matches(lower(code), 'traceback|error|failed|exception|assertionerror') AS crit FROM s),
g AS (SELECT *, count(*) FILTER (NOT is_end AND NOT crit) OVER w AS free_rank, count(*) FILTER (NOT is_end AND crit) OVER w AS crit_rank,
   count(*) FILTER (is_end) OVER p AS ends, count(*) FILTER (crit AND NOT is_end) OVER p AS crits
   FROM f WINDOW w AS (PARTITION BY task_name ORDER BY step), p AS (PARTITION BY task_name)),
slots AS (SELECT task_name, n, ends, crits, unnest(range(1, {budget + 1})) AS s FROM (SELECT DISTINCT task_name, n, ends, crits FROM g)),
picks AS (SELECT task_name, s * (n - ends - crits) // ({budget} - ends - crits + 1) AS free_pick FROM slots WHERE {budget} - ends - crits > 0 AND s <= {budget} - ends - crits),
cpicks AS (SELECT task_name, s * crits // ({budget} - ends + 1) AS crit_pick FROM slots WHERE ends + crits > {budget} AND s <= {budget} - ends)
SELECT task_name, step, action, code FROM g WHERE n <= {budget} OR is_end OR (crit AND {budget} - ends - crits >= 0)
  OR (crit AND EXISTS (SELECT 1 FROM cpicks c WHERE c.task_name = g.task_name AND c.crit_pick = g.crit_rank - 1))
  OR (NOT crit AND EXISTS (SELECT 1 FROM picks c WHERE c.task_name = g.task_name AND c.free_pick = g.free_rank - 1))"""


@query("evidence_sample", _sample_sql(40, 4, 6))
def evidence_sample(spark, sf):
    return S.select_steps(evidence_steps(spark, sf), ["task_name"], budget=40, head=4, tail=6)


@query("evidence_sample_full", _sample_sql(120, 8, 24))
def evidence_sample_full(spark, sf):
    """The operator's own sizes."""
    return S.select_steps(evidence_steps(spark, sf), ["task_name"])


@query("causal_steps", f"""WITH {V.STEPS_SQL},
c AS (SELECT {A}, step_idx, tool_name AS action, coalesce(a_command, a_path) AS code FROM steps WHERE regexp_matches(lower(tool_name), 'write|edit|create|save|bash'))
SELECT {A}, 's' || step_idx AS id, action, step_idx AS step FROM c QUALIFY row_number() OVER (PARTITION BY {A} ORDER BY step_idx DESC) <= 10""")
def causal_steps(spark, sf):
    d = V.steps(spark, sf).filter(F.col("tool_name").isNotNull()).select(
        *TR.ATTEMPT, F.col("step_idx").alias("step"), F.col("tool_name").alias("action"),
        F.coalesce(F.col("args")["command"], F.col("args")["file_path"]).alias("code"))
    return R.causal_steps(d).select(*TR.ATTEMPT, "id", "action", "step")


# A packet's lists are compared as digests of their entries joined in order.
@query("evidence_packets", f"""WITH {V.merge_ctes(V.STEPS_SQL, V.ATTEMPTS_SQL)},
c AS (SELECT {A}, step_idx, tool_name AS action, CASE WHEN k % 3 = 0 THEN 'write [redacted path] for ' || k ELSE 'run ' || k END AS detail FROM steps WHERE tool_name IS NOT NULL AND attempt_number % 4 <> 0),
s AS (SELECT {A}, string_agg('s' || step_idx || '=' || action || '=' || detail, ';' ORDER BY step_idx) AS steps, count(*) AS n FROM c GROUP BY ALL),
u AS (SELECT * FROM c WHERE regexp_matches(lower(action), 'write|edit|create|save|bash|tool_result_error') QUALIFY row_number() OVER (PARTITION BY {A} ORDER BY step_idx DESC) <= 10),
z AS (SELECT {A}, string_agg('s' || step_idx || '=' || action || '=' || detail, ';' ORDER BY step_idx) AS causal FROM u GROUP BY ALL),
e AS (SELECT {A}, step_idx, CASE WHEN k % 7 = 0 THEN 'verifier' ELSE 'check-' || (k % 5) END AS name, CASE WHEN k % 2 = 0 THEN 'failed' ELSE 'passed' END AS status,
  CASE WHEN k % 3 = 0 THEN '[redacted credential] in [redacted path]' ELSE 'note ' || k END AS message, k % 3 = 0 AS redacted FROM steps WHERE event_type IN ('error', 'view')),
f AS (SELECT {A}, string_agg(name || '=' || status || '=' || message || '=' || redacted, ';' ORDER BY step_idx) AS feedback FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY {A} ORDER BY step_idx) <= 25) GROUP BY ALL),
g AS (SELECT {A}, string_agg(name, ';' ORDER BY first) AS failed FROM (SELECT {A}, CASE WHEN name = 'verifier' THEN '' ELSE name END AS name, min(step_idx) AS first FROM e WHERE status = 'failed' GROUP BY ALL) GROUP BY ALL)
SELECT a.task_family, a.task_name, a.attempt_number, CASE WHEN verifier_passed THEN 1.0 ELSE 0.0 END::DOUBLE AS reward, CASE WHEN a.attempt_number % 3 = 0 THEN 'crash in [redacted path]' END AS exception,
  'Reconcile ' || a.task_name || ' with [redacted path]' AS objective, 'must keep ' || a.task_name || ';only once' AS constraints, coalesce(failed, '') AS failed_checks, sha256(coalesce(feedback, '')) AS feedback,
  sha256(coalesce(steps, '')) AS steps, coalesce(n, 0) AS n_steps, sha256(coalesce(causal, '')) AS causal,
  sha256(CASE WHEN steps IS NOT NULL THEN '' WHEN a.attempt_number % 8 = 0 THEN '(no trajectory available)' ELSE left(r, 2000) || chr(10) || chr(10) || '# ... [middle snipped] ...' || chr(10) || chr(10) || right(r, 2000) END) AS fallback
FROM (SELECT *, repeat('log of ' || task_name || '; ', 400) AS r FROM attempts WHERE NOT verifier_passed) a LEFT JOIN s USING ({A}) LEFT JOIN z USING ({A}) LEFT JOIN f USING ({A}) LEFT JOIN g USING ({A})""")
def evidence_packets(spark, sf):
    a, steps = V.attempts(spark, sf), V.steps(spark, sf)
    k, n = F.col("k"), F.col("attempt_number")
    a = a.withColumn("exception_info", F.when(n % 3 == 0, "crash in /srv/run/in.csv"))
    compact = steps.where(F.col("tool_name").isNotNull() & (n % 4 != 0)).select(*TR.ATTEMPT, F.col("step_idx").alias("step"), F.col("tool_name").alias("action"), F.when(
        k % 3 == 0, F.concat(F.lit("write /srv/out/a.csv for "), k.cast("string"))).otherwise(F.concat(F.lit("run "), k.cast("string"))).alias("code"))
    feedback = steps.where(F.col("event_type").isin("error", "view")).select(
        *TR.ATTEMPT, F.col("step_idx").alias("pos"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("check-"), (k % 5).cast("string"))).alias("name"),
        F.when(k % 2 == 0, "failed").otherwise("passed").alias("status"), F.when(k % 3 == 0, "password=abc in /srv/a/b.csv").otherwise(F.concat(F.lit("note "), k.cast("string"))).alias("message"))
    tasks = a.select("task_family", "task_name").distinct()
    contracts = tasks.select("*", F.concat(F.lit("Reconcile "), "task_name", F.lit(" with /srv/run/ledger.csv")).alias("objective"),
                             F.array(F.concat(F.lit("must keep "), "task_name"), F.lit("only once")).alias("constraints"))
    raw = a.where(n % 8 != 0).select(*TR.ATTEMPT, F.repeat(F.concat(F.lit("log of "), "task_name", F.lit("; ")), 400).alias("text"))
    d = R.evidence_packets(a, compact, feedback, contracts, raw)
    joined = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws("=", *(x[i].cast("string") for i in names))), ";")
    return d.select(*TR.ATTEMPT, "reward", "exception", "objective", F.array_join("constraints", ";").alias("constraints"), F.array_join("failed_verifier_checks", ";").alias("failed_checks"),
                    F.sha2(joined("verifier_feedback", "name", "status", "message", "redacted"), 256).alias("feedback"), F.sha2(joined("trajectory_steps", "id", "action", "detail"), 256).alias("steps"),
                    F.size("trajectory_steps").cast("long").alias("n_steps"), F.sha2(joined("causal_candidates", "id", "action", "detail"), 256).alias("causal"), F.sha2("fallback_trajectory", 256).alias("fallback"))


@query("step_usage", f"""WITH {V.STEPS_SQL}
SELECT {A}, step_idx, list_distinct(regexp_extract_all(t, '(?i)scripts/(?:experimental|capabilities)/([a-z0-9_.-]+\\.py)', 1))[1] AS script,
  list_distinct(regexp_extract_all(t, '(?i)references/(?:policies/)?([a-z0-9][a-z0-9-]+)\\.md', 1))[1] AS policy, len(regexp_extract_all(t, '(?i)mcp__experience_memory__(?:search_memories|get_memory)')) AS memory_queries
FROM (SELECT *, CASE WHEN k < 20 THEN 'python scripts/capabilities/fix_' || k || '.py' WHEN k < 50 THEN 'read references/policies/rule-' || (k % 5) || '.md'
                WHEN k < 60 THEN 'mcp__experience_memory__search_memories' ELSE 'x' END AS t FROM steps)""")
def step_usage(spark, sf):
    k = F.col("k")
    text = (F.when(k < 20, F.concat(F.lit("python scripts/capabilities/fix_"), k.cast("string"), F.lit(".py")))
            .when(k < 50, F.concat(F.lit("read references/policies/rule-"), (k % 5).cast("string"), F.lit(".md")))
            .when(k < 60, "mcp__experience_memory__search_memories").otherwise("x"))
    d = V.steps(spark, sf).withColumn("u", T.usage(text))
    return d.select(*TR.ATTEMPT, "step_idx", F.get("u.scripts", 0).alias("script"), F.get("u.policies", 0).alias("policy"),
                    F.col("u.memory_queries").cast("long").alias("memory_queries"))


def _usage_text():
    k = F.col("k")
    return (F.when(k < 20, F.concat(F.lit("python scripts/capabilities/fix_"), k.cast("string"), F.lit(".py")))
            .when(k < 50, F.concat(F.lit("read references/policies/rule-"), (k % 5).cast("string"), F.lit(".md")))
            .when(k < 60, "mcp__experience_memory__search_memories").otherwise("x"))


@query("attempt_usage", f"""WITH {V.STEPS_SQL}, u AS (SELECT *, CASE WHEN k < 20 THEN 'scripts' ELSE 'policies' END AS kind, CASE WHEN k < 20 THEN 'fix_' || k || '.py' ELSE 'rule-' || (k % 5) END AS used_id FROM steps WHERE k < 50)
SELECT {A}, kind, used_id, min(step_idx) AS first_step FROM u GROUP BY ALL""")
def attempt_usage(spark, sf):
    return TR.attempt_usage(V.steps(spark, sf), _usage_text())


@query("memory_query_counts", f"""WITH {V.STEPS_SQL} SELECT {A}, count(*) FILTER (k >= 50 AND k < 60) AS memory_query_count FROM steps GROUP BY {A}""")
def memory_query_counts(spark, sf):
    return TR.memory_queries(V.steps(spark, sf), _usage_text())
