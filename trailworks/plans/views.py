"""Documented views: driver tables in the shape the operators expect, with their SQL twins.

A task is a user, an attempt is one week of that user, a step is one event in time order.
Event types become tools; the number ``k`` in the event properties picks one of a few fixed
command, message and result texts. Every row of ``events`` becomes exactly one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import numbered  # noqa: F401
from ..operators import trajectory as TR

# --- Fixed values: texts of the step view ---------------------------------------------------
COMMANDS = (
    'grep -rn "total" data/report_{k}.csv',
    "cat notes_{k}.md",
    "python -c \"import openpyxl; wb.save('book_{k}.xlsx')\"",
    "python -c \"import pdfplumber; pdfplumber.open('scan_{k}.pdf')\"",
    "python -c \"json.load(open('cfg_{k}.json'))\"",
    "python -c \"pd.read_csv('in_{k}.csv').to_csv('out_{k}.csv')\"",
    "python run.py --n {k} > result_{k}.txt",
    "pytest tests/test_{k}.py",
    "git status",
    "curl https://host.example/api/{k}",
    "ls -la /srv/data/{k}",
    "python validate.py /srv/run/{k}/out_{k}.xlsx REC1{k}0",
)
ERRORS = (
    "Traceback (most recent call last): KeyError: col",
    "FileNotFoundError: No such file input.csv",
    "ModuleNotFoundError: pandas",
    "Permission denied",
    "process returned exit code 2",
    "schema mismatch, sheet failed",
    "assert total == 3 failed",
    "connection timeout error: 504",
    "unable to parse header",
)
MESSAGES = (
    "Let me try a different approach",
    "The plan looks fine",
    "I need to fix the parser",
    "Reading the input next",
    "It failed because the sheet moved",
    "Switch to the other file instead",
)
FILES = ("input.csv", "report.xlsx", "cfg.json", "notes.md", "scan.pdf")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(values: tuple[str, ...], k: Column) -> Column:
    text = F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    return F.replace(text, F.lit("{k}"), k.cast("string"))


def _sql_pick(values: tuple[str, ...]) -> str:
    items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"replace(([{items}])[k % {len(values)} + 1], '{{k}}', CAST(k AS VARCHAR))"


def _event_base(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", "ts", "event_type", "value", "user_id",
        F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int").alias("k"),
        F.concat(F.lit("family-"), (F.col("user_id") % 7).cast("string")).alias("task_family"),
        F.concat(F.lit("task-"), F.col("user_id").cast("string")).alias("task_name"),
        (F.floor(F.datediff(ts, F.lit("2024-01-01").cast("date")) / 7) + 1).cast("int").alias("attempt_number"))


def steps(spark: SparkSession, sf: str) -> DataFrame:
    d = numbered(_event_base(spark, sf), TR.ATTEMPT, ["ts", "event_id"], "step_idx", F.to_date("ts"))
    k, kind = F.col("k"), F.col("event_type")
    bash = kind.isin("click", "error")
    path = F.concat(F.lit("/srv/run/"), (k % 10).cast("string"), F.lit("/"), _pick(FILES, k))
    tool = F.when(bash, "Bash").when(kind == "view", "Read").when(
        kind == "purchase", F.when(k % 2 == 0, "Write").otherwise("Edit"))
    none = F.lit(None).cast("string")
    args = F.map_filter(F.create_map(
        F.lit("command"), F.when(bash, _pick(COMMANDS, k)),
        F.lit("description"), F.when(bash, F.concat(F.lit("run step "), (k % 4).cast("string"))),
        F.lit("file_path"), F.when(kind.isin("view", "purchase"), path),
        F.lit("content"), F.when((kind == "purchase") & (k % 2 == 0), F.concat(F.lit("rows = "), k.cast("string")))),
        lambda _, v: v.isNotNull())
    return d.select(
        *TR.ATTEMPT, "step_idx", F.when((kind == "signup") & (k % 5 == 0), "user").otherwise("agent").alias("source"),
        F.when(kind == "signup", _pick(MESSAGES, k)).otherwise("").alias("message"),
        F.coalesce(tool, none).alias("tool_name"), args.alias("args"),
        F.when(kind == "error", _pick(ERRORS, k)).when(kind == "signup", "").otherwise("ok").alias("result_text"),
        F.lit(None).cast("boolean").alias("is_error"), "event_type", "k", "ts")


def calls(spark: SparkSession, sf: str) -> DataFrame:
    return TR.tool_calls(steps(spark, sf))


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per attempt: passed if the last event is a purchase or a click."""
    d = _event_base(spark, sf)
    at = F.struct("ts", "event_id")
    err = F.col("event_type") == "error"
    last = F.max_by("event_type", at)
    text = _pick(ERRORS, F.col("k"))
    a = d.groupBy(*TR.ATTEMPT).agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_if(err).alias("n_errors"), last.isin("purchase", "click").alias("verifier_passed"),
        F.round(F.sum("value"), 2).alias("total_value"), F.max_by("k", at).alias("last_k"),
        F.max_by(F.when(err, text), F.when(err, at)).alias("_last_error"), F.max_by(F.when(err, F.col("k")), F.when(err, at)).alias("_err_k"))
    reflection = F.concat(
        F.lit("FAILURE OBSERVABLE: "), F.col("_last_error"), F.lit("\nROOT CAUSE: Sheet "), F.col("_err_k").cast("string"),
        F.lit(" was read from /srv/run/in.csv\nCORRECTIVE ACTION: Reload file "), (F.col("_err_k") % 10).cast("string"),
        F.lit(" and compare\n  the totals again"))
    return a.select(*TR.ATTEMPT, "n_steps", "n_errors", "verifier_passed", "last_k",
                    F.when(F.col("verifier_passed"), 1.0).otherwise(0.0).alias("reward"),
                    F.when(~F.col("verifier_passed") & (F.col("n_errors") > 0), reflection).otherwise("").alias("reflection"),
                    F.concat_ws(":", "task_name", F.col("attempt_number").cast("string")).alias("attempt_id"))


# --- the same views in SQL ------------------------------------------------------------------

ATT = "task_family, task_name, attempt_number"

EVENTS_SQL = """
ev AS (
  SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
         'family-' || (user_id % 7) AS task_family, 'task-' || user_id AS task_name,
         CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS INTEGER) + 1 AS attempt_number
  FROM events)"""

STEPS_SQL = EVENTS_SQL + f""",
steps AS (
  SELECT {ATT}, row_number() OVER (PARTITION BY task_name, attempt_number ORDER BY ts, event_id) AS step_idx,
         event_type, k, ts, event_id, value,
         CASE WHEN event_type = 'signup' AND k % 5 = 0 THEN 'user' ELSE 'agent' END AS source,
         CASE WHEN event_type = 'signup' THEN {_sql_pick(MESSAGES)} ELSE '' END AS message,
         CASE WHEN event_type IN ('click', 'error') THEN 'Bash' WHEN event_type = 'view' THEN 'Read'
              WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'Write' WHEN event_type = 'purchase' THEN 'Edit' END AS tool_name,
         CASE WHEN event_type IN ('click', 'error') THEN {_sql_pick(COMMANDS)} END AS a_command,
         CASE WHEN event_type IN ('click', 'error') THEN 'run step ' || (k % 4) END AS a_description,
         CASE WHEN event_type IN ('view', 'purchase') THEN '/srv/run/' || (k % 10) || '/' || {_sql_pick(FILES)} END AS a_path,
         CASE WHEN event_type = 'error' THEN {_sql_pick(ERRORS)} WHEN event_type = 'signup' THEN '' ELSE 'ok' END AS result_text
  FROM ev)"""

# Fixed values, as in functions/fixed.py and in DuckDB's syntax: file endings and commands that write files.
EXT = "|".join(("xlsx", "xls", "csv", "tsv", "json", "jsonl", "yaml", "yml", "py", "sh", "md", "txt", "docx", "doc", "pdf",
                "html", "xml", "png", "jpg", "jpeg", "svg", "sql", "db", "sqlite", "parquet", "pkl", "pickle", "h5", "pt",
                "onnx", "toml", "cfg", "ini", "log"))


def sql_distinct(expr: str) -> str:
    """Ordered distinct list."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def sql_paths(expr: str) -> str:
    return sql_distinct(f"regexp_extract_all({expr}, '(?i)[\\w\\-./]+\\.(?:{EXT})\\b')")


# Fixed values, as above.
_WRITES = (
    r"""(?i)open\(\s*[''"][^''"]+\.[\w]+[''"]\s*,\s*[''"][^''"]*[wax+][^''"]*[''"]""",
    r"""(?i)\.(?:save|write_text|write_bytes|to_csv|to_json|to_excel|to_parquet|to_pickle|to_markdown)\(\s*[''"][^''"]+\.[\w]+[''"]""",
    r"""(?i)(?:^|[\s;])>>?\s*[''"]?[\w./-]+\.[\w]+[''"]?""",
    r"""(?i)(?:^|[;&\n])\s*(?:cp|mv)\s+(?:-[^\s]+\s+)*[''"]?[\w./-]+\.[\w]+[''"]?\s+[''"]?[\w./-]+\.[\w]+[''"]?""",
    r"""(?i)(?:^|[;&\n])\s*touch\s+[''"]?[\w./-]+\.[\w]+[''"]?""",
)


def sql_written(expr: str) -> str:
    parts = ", ".join(f"array_to_string(regexp_extract_all({expr}, '{p}'), chr(10))" for p in _WRITES)
    return sql_paths(f"concat_ws(chr(10), {parts})")


SQL_IS_ERROR = """(len(list_filter(regexp_extract_all(result_text, '(?i)(?:exit code|exit status|returncode)[:\\s=]*(\\d+)', 1), lambda c: CAST(c AS INTEGER) <> 0)) > 0
 OR regexp_matches(result_text, 'Traceback \\(most recent call last\\)|Error:|error:|FAILED|ModuleNotFoundError|KeyError|FileNotFoundError|AttributeError|TypeError|ValueError|ImportError|Permission denied|command not found|No such file|SyntaxError|IndentationError|NameError|RuntimeError|AssertionError|ZeroDivisionError')
 OR regexp_matches(lower(result_text), '\\bfailed\\b|\\bfailure\\b|not found|cannot (?:find|open|read|write|parse|import)|unable to|invalid (?:file|path|argument|value|format|syntax|option)|no (?:module|file|such|attribute)|unexpected (?:error|exception|token|indent)|exception (?:raised|occurred|thrown)')
 OR (contains(lower(result_text), 'assert ') AND regexp_matches(lower(result_text), 'false|fail')))"""

CALLS_SQL = STEPS_SQL + f""",
calls0 AS (
  SELECT {ATT}, step_idx, tool_name, k,
         CASE WHEN tool_name = 'Bash' THEN a_command WHEN tool_name = 'Write' THEN 'rows = ' || k ELSE '' END AS command,
         CASE tool_name WHEN 'Bash' THEN a_description WHEN 'Read' THEN 'Read ' || a_path WHEN 'Write' THEN 'Write → ' || a_path
              ELSE 'Edit ' || a_path END AS description,
         a_path, {sql_paths("coalesce(a_command, '')")} AS bash_paths, {sql_written("coalesce(a_command, '')")} AS bash_written,
         NOT {SQL_IS_ERROR} AS success, CASE WHEN {SQL_IS_ERROR} THEN result_text ELSE '' END AS error_message
  FROM steps WHERE tool_name IS NOT NULL),
calls AS (
  SELECT {ATT}, step_idx, tool_name, command, description,
         CASE WHEN tool_name = 'Bash' THEN list_filter(bash_paths, lambda p: NOT list_contains(bash_written, p))
              WHEN tool_name IN ('Read', 'Edit') THEN [a_path] ELSE [] END AS input_files,
         CASE WHEN tool_name = 'Bash' THEN list_filter(bash_paths, lambda p: list_contains(bash_written, p))
              WHEN tool_name IN ('Write', 'Edit') THEN [a_path] ELSE [] END AS output_files,
         success, error_message
  FROM calls0)"""

ATTEMPTS_SQL = EVENTS_SQL + f""",
att0 AS (
  SELECT {ATT}, count(*) AS n_steps, count(*) FILTER (event_type = 'error') AS n_errors,
         arg_max(event_type, (ts, event_id)) IN ('purchase', 'click') AS verifier_passed, arg_max(k, (ts, event_id)) AS last_k,
         arg_max({_sql_pick(ERRORS)}, (ts, event_id)) FILTER (event_type = 'error') AS last_error,
         arg_max(k, (ts, event_id)) FILTER (event_type = 'error') AS err_k
  FROM ev GROUP BY ALL),
attempts AS (
  SELECT {ATT}, n_steps, n_errors, verifier_passed, last_k, CASE WHEN verifier_passed THEN 1.0 ELSE 0.0 END AS reward,
         task_name || ':' || attempt_number AS attempt_id,
         CASE WHEN NOT verifier_passed AND n_errors > 0 THEN 'FAILURE OBSERVABLE: ' || last_error || chr(10) || 'ROOT CAUSE: Sheet ' || err_k
              || ' was read from /srv/run/in.csv' || chr(10) || 'CORRECTIVE ACTION: Reload file ' || (err_k % 10) || ' and compare'
              || chr(10) || '  the totals again' ELSE '' END AS reflection
  FROM att0)"""


def merge_ctes(*parts: str) -> str:
    """Join CTE lists, keeping the first definition of each name."""
    import re
    seen, out = set(), []
    for part in parts:
        for piece in re.split(r",?\n(?=\w+ AS \()", part):
            m = re.match(r"\s*(\w+) AS \(", piece)
            if m and m.group(1) not in seen:
                seen.add(m.group(1))
                out.append(piece.strip().rstrip(","))
    return ",\n".join(out)
