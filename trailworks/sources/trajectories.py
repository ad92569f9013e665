"""Trajectory files to tables.

Files come as rows with their path; every row keeps ``trial_path``, the folder of its trial. Readers take ``files``
(see ``trial_files``) where several of them share one reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as SC
from ..functions import fixed as X
from ..functions.errors import result_text
from ..functions.lists import non_empty, strip
from ..functions.sequence import numbered
from ..session import cut_lineage
from .files import read_files

# File layout of a trial.
STEP_FILE = "agent/trajectory.json"
LOG_FILES = ("agent/claude-code.txt", "agent/claude_code.txt", "sessions/agent.log")
REFLECTION_GLOB = "reflection_attempt_*.md"
FILES = ("attempt_manifest.json", "trajectory.json", "result.json", "reward.txt", REFLECTION_GLOB)


def _trial(path: Column, tail: str) -> Column:
    return F.regexp_replace(path, "/" + tail + "$", "")


def trial_files(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """(path, name, piece, content) of the files of a trial tree, of all kinds or of ``names``; listed and read once."""
    logs = tuple(p.rsplit("/", 1)[1] for p in LOG_FILES)
    names = names or (*FILES, *logs)
    d = read_files(spark, root, tuple(n for n in names if n not in logs), tuple(n for n in names if n in logs))
    return cut_lineage(d.withColumn("name", F.substring_index("path", "/", -1)))


def _json(files: DataFrame, name: str, schema: T.StructType) -> DataFrame:
    """Documents of one name: a row each, or one for each item if the document is a list. Empty files have none."""
    text = F.col("content").cast("string")
    items = F.when(F.ltrim(F.regexp_replace(F.substring(text, 1, 100), r"\s+", " ")).startswith("["), F.from_json(text, T.ArrayType(schema))).otherwise(F.array(F.from_json(text, schema)))
    d = files.filter((F.col("name") == name) & (F.length(strip(text)) > 0))
    return d.select("path", F.explode_outer(items).alias("_item")).select(*[F.col("_item")[c].alias(c) for c in schema.names], "path")


def _text(files: DataFrame, pattern: str) -> DataFrame:
    return files.filter(F.col("name").like(pattern)).select(F.col("content").cast("string").alias("value"), "path")


def manifests(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """Attempts listed in staged manifests."""
    d = _json(files if files is not None else trial_files(spark, root, "attempt_manifest.json"), "attempt_manifest.json", SC.MANIFEST)
    folder = _trial(F.col("path"), r"attempt_manifest\.json")
    d = d.select(folder.alias("task_path"), F.coalesce(non_empty(F.col("task_name")), F.regexp_extract(folder, r"([^/]+)$", 1))
                 .alias("task_name"), F.explode("attempts").alias("a"))
    number = F.coalesce("a.number", F.lit(0))
    return d.select(
        "task_path", "task_name", number.alias("attempt_number"),
        F.concat_ws(":", "task_name", number.cast("string")).alias("attempt_id"),
        F.concat(F.col("task_path"), F.lit("/attempts/attempt_"), F.lpad(number.cast("string"), 2, "0")).alias("trial_path"),
        F.coalesce("a.success", F.lit(False)).alias("verifier_passed"), F.col("a.reward").alias("reward"),
        F.col("a.exception_info").alias("exception_info"), F.col("a.reflection_files").alias("listed_files"))


def step_files(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """Steps of trajectory documents, indexed from 1."""
    d = _json(files if files is not None else trial_files(spark, root, "trajectory.json"), "trajectory.json", SC.TRAJECTORY)
    d = d.filter(F.col("path").endswith(STEP_FILE)).select(
        _trial(F.col("path"), r"agent/trajectory\.json").alias("trial_path"), F.posexplode_outer("steps").alias("pos", "s"))
    meta = F.col("s.extra.tool_result_metadata")
    return d.select(
        "trial_path", (F.col("pos") + 1).alias("step_idx"), F.col("s.source").alias("source"),
        F.coalesce("s.message", F.lit("")).alias("message"), F.col("s.extra.tool_use_name").alias("tool_name"),
        F.col("s.extra.tool_use_id").alias("tool_use_id"), F.col("s.extra.raw_arguments").alias("args"),
        result_text(meta["truncated"], meta["content"], meta["raw_tool_result"]["content"],
                    meta["tool_use_result"]["stdout"], meta["tool_use_result"]["stderr"]).alias("result_text"),
        (F.coalesce(F.col("s.extra.is_error"), F.lit(False)) | F.coalesce(meta["is_error"], F.lit(False))).alias("is_error"))


def log_lines(lines: DataFrame) -> DataFrame:
    """S3 front half: blocks of each JSON line. ``lines``: trial_path, line_no, value."""
    d = lines.filter(F.col("value").startswith("{")).withColumn("e", F.from_json("value", SC.LOG_EVENT)).filter(
        F.col("e.type").isNotNull())
    body = F.coalesce(F.get_json_object("e.message", "$.content"), F.when(
        ~F.col("e.message").startswith("{"), F.col("e.message")), F.lit(""))
    d = d.withColumn("body", body).withColumn("is_list", F.col("body").startswith("["))
    return d.withColumn("blocks", F.when(F.col("is_list"), F.from_json("body", T.ArrayType(SC.CONTENT_BLOCK))))


def log_steps(lines: DataFrame) -> DataFrame:
    """S3: steps of a stream log; each result goes to the nearest earlier call with its id.

    Calls and results meet by (trial, tool id); the last result of a call wins.
    """
    d = log_lines(lines)
    none = F.lit(None).cast("string")
    user_text = F.when(F.col("is_list"), F.array_join(F.transform(F.filter(
        "blocks", lambda b: (F.coalesce(b["type"], F.lit("")) != "tool_result") & (F.length(b["text"]) > 0)),
        lambda b: b["text"]), " ")).otherwise(F.col("body"))
    users = d.filter((F.col("e.type") == "user") & (F.length(strip(user_text)) > 0)).select(
        "trial_path", "line_no", F.lit(-1).alias("block"), F.lit("user").alias("source"),
        F.substring(user_text, 1, 1000).alias("message"), none.alias("tool_name"), none.alias("tool_use_id"),
        F.lit(None).cast("map<string,string>").alias("args"))
    blocks = d.filter((F.col("e.type") == "assistant") & F.col("is_list")).select(
        "trial_path", "line_no", F.posexplode("blocks").alias("block", "b"))
    text = (F.col("b.type") == "text") & (F.length(strip(F.coalesce("b.text", F.lit("")))) > 0)
    call = F.col("b.type") == "tool_use"
    agents = blocks.filter(text | call).select(
        "trial_path", "line_no", "block", F.lit("agent").alias("source"),
        F.when(text, F.substring("b.text", 1, 300)).otherwise("").alias("message"),
        F.when(call, F.coalesce("b.name", F.lit(""))).alias("tool_name"),
        F.when(call, F.coalesce("b.id", F.lit(""))).alias("tool_use_id"), F.when(call, F.col("b.input")).alias("args"))
    rows = users.unionByName(agents)
    nested = d.filter((F.col("e.type") == "user") & F.col("is_list")).select(
        "trial_path", "line_no", F.posexplode("blocks").alias("block", "b")).filter(F.col("b.type") == "tool_result").select(
        "trial_path", "line_no", "block", F.col("b.tool_use_id").alias("tool_use_id"),
        F.substring(F.coalesce("b.content", F.lit("")), 1, 2000).alias("result"), F.coalesce("b.is_error", F.lit(False)).alias("err"))
    plain = d.filter(F.col("e.type") == "tool_result").select(
        "trial_path", "line_no", F.lit(0).alias("block"), F.col("e.tool_use_id").alias("tool_use_id"),
        F.substring("body", 1, 2000).alias("result"), F.coalesce("e.is_error", F.lit(False)).alias("err"))
    results = nested.unionByName(plain).filter(F.length("tool_use_id") > 0)
    at = F.struct("line_no", "block")
    calls = rows.filter(F.length("tool_use_id") > 0).select("trial_path", "tool_use_id", at.alias("call_at"))
    owner = results.withColumn("res_at", at).join(calls, ["trial_path", "tool_use_id"]).filter(
        F.col("call_at") < F.col("res_at")).groupBy("trial_path", "tool_use_id", "res_at").agg(
        F.max("call_at").alias("call_at"), F.first("result").alias("result"), F.first("err").alias("err"))
    last = owner.groupBy("trial_path", "tool_use_id", "call_at").agg(
        F.max_by("result", "res_at").alias("result_text"), F.max_by("err", "res_at").alias("is_error"))
    d = rows.withColumn("call_at", at).join(last, ["trial_path", "tool_use_id", "call_at"], "left")
    d = numbered(d, ["trial_path"], ["line_no", "block"], "step_idx", F.floor(F.col("line_no") / 1024))
    return d.select("trial_path", "step_idx", "source", "message", "tool_name", "tool_use_id", "args",
                    F.coalesce("result_text", F.lit("")).alias("result_text"), "is_error")


def log_files(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """S3: the first existing stream log of each trial, line by line.

    Large logs come in pieces; lines are numbered by piece and by their order inside it.
    """
    files = files if files is not None else trial_files(spark, root, *(p.rsplit("/", 1)[1] for p in LOG_FILES))
    rank = F.coalesce(*[F.when(F.col("path").endswith("/" + p), F.lit(i)) for i, p in enumerate(LOG_FILES)])
    d = files.withColumn("_rank", rank).filter(F.col("_rank").isNotNull()).withColumn(
        "trial_path", F.regexp_replace("path", r"/(agent|sessions)/[^/]+$", ""))
    best = d.groupBy("trial_path").agg(F.min("_rank").alias("_rank"))
    d = d.join(best, ["trial_path", "_rank"], "left_semi")
    # the end of the last line begins no other
    rows = F.split(F.regexp_replace(F.col("content").cast("string"), r"(?:\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")
    d = d.filter(F.length("content") > 0).select("trial_path", "piece", F.posexplode(rows).alias("_at", "value"))
    return numbered(d, ["trial_path"], ["_at"], "line_no", F.col("piece")).select("trial_path", "line_no", "value")


def reflections(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """Reflection sidecars of a trial, sorted by name, joined by a blank line."""
    d = _text(files if files is not None else trial_files(spark, root, REFLECTION_GLOB), r"reflection\_attempt\_%.md").select(
        F.regexp_replace("path", r"/[^/]+$", "").alias("trial_path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        strip(F.col("value")).alias("text"))
    return d


def joined_reflections(files: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Only listed names if a manifest lists any. ``listed``: trial_path, name."""
    d = files
    if listed is not None:
        has = listed.select("trial_path").distinct().withColumn("_has", F.lit(True))
        d = d.join(has, "trial_path", "left").join(listed.withColumn("_in", F.lit(True)), ["trial_path", "name"], "left")
        d = d.filter(F.col("_has").isNull() | F.col("_in"))
    parts = F.array_sort(F.collect_set(F.struct("name", "text")))   # a trial has a handful of sidecars
    return d.groupBy("trial_path").agg(
        F.transform(parts, lambda p: p["name"]).alias("reflection_files"),
        F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: F.length(t) > 0), "\n\n").alias("reflection"))


def outcomes(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """Reward of a direct trial: nested reward, flat reward, then the reward file."""
    files = files if files is not None else trial_files(spark, root, "result.json", "reward.txt")
    r = _json(files, "result.json", SC.RESULT).select(
        _trial(F.col("path"), r"result\.json").alias("trial_path"),
        F.coalesce("verifier_result.rewards.reward", "reward").alias("json_reward"))
    t = _text(files, "reward.txt").select(
        _trial(F.col("path"), r"verifier/reward\.txt").alias("trial_path"), strip(F.col("value")).try_cast("double").alias("file_reward"))
    return r.join(t, "trial_path", "full").select(
        "trial_path", F.coalesce("json_reward", "file_reward").alias("reward")).withColumn(
        "verifier_passed", F.coalesce(F.col("reward") >= 1.0, F.lit(False)))


def load_trials(spark: SparkSession, root: str, task_family: str = "") -> tuple[DataFrame, DataFrame]:
    """(attempts, steps) of a job folder; a trial counts if it has steps or a reflection."""
    files = trial_files(spark, root)
    staged = manifests(spark, root, files)
    docs = step_files(spark, root, files)
    logs = log_steps(log_files(spark, root, files)).join(docs.select("trial_path").distinct(), "trial_path", "left_anti")
    raw = docs.unionByName(logs)
    listed = staged.select("trial_path", F.explode("listed_files").alias("name")).filter(
        F.col("name").startswith("reflection_attempt_") & F.col("name").endswith(".md"))
    refl = joined_reflections(reflections(spark, root, files), listed)
    have = raw.select("trial_path").distinct().withColumn("has_steps", F.lit(True))
    direct = have.select("trial_path").unionByName(refl.select("trial_path")).distinct() \
        .join(staged.select("trial_path"), "trial_path", "left_anti").join(outcomes(spark, root, files), "trial_path", "left") \
        .withColumn("task_name", F.regexp_extract("trial_path", r"([^/]+)$", 1))
    cols = ["trial_path", "task_name", "attempt_number", "attempt_id", "verifier_passed", "reward"]
    trials = staged.select(*cols).unionByName(direct.select(
        "trial_path", "task_name", F.lit(1).alias("attempt_number"), F.col("task_name").alias("attempt_id"),
        F.coalesce("verifier_passed", F.lit(False)).alias("verifier_passed"), "reward"))
    attempts = trials.join(have, "trial_path", "left").join(refl, "trial_path", "left").filter(
        F.col("has_steps") | (F.length("reflection") > 0)).select(
        F.lit(task_family).alias("task_family"), *cols, F.coalesce("reflection", F.lit("")).alias("reflection"),
        F.coalesce("reflection_files", F.array().cast("array<string>")).alias("reflection_files"))
    steps = raw.filter(F.col("step_idx").isNotNull()).join(
        attempts.select("task_family", "task_name", "attempt_number", "trial_path"), "trial_path").drop("trial_path")
    return attempts, steps


def collect_results(spark: SparkSession, root: str) -> DataFrame:
    """One row per (task, trial); success needs no exception and a reward of at least 1."""
    files = trial_files(spark, root, "result.json", "config.json")
    r = _json(files, "result.json", SC.RESULT).withColumn("folder", _trial(F.col("path"), r"result\.json"))
    c = _json(files, "config.json", SC.struct(task=SC.struct(path=SC.S))).select(
        _trial(F.col("path"), r"config\.json").alias("folder"), F.col("task.path").alias("task_path"))
    name = F.regexp_extract(F.trim("task_path"), r"([^/]+)/*$", 1)
    nested = F.coalesce("verifier_result.rewards.reward", F.lit(0.0))
    reward = F.when(nested == 0.0, F.coalesce("reward", F.lit(0.0))).otherwise(nested)
    d = r.join(c, "folder", "left").select(
        F.coalesce(non_empty(name), F.col("task_name"), F.regexp_extract("folder", r"([^/]+)$", 1)).alias("task_name"),
        F.coalesce("trial_name", F.regexp_extract("folder", r"([^/]+)$", 1)).alias("trial_name"),
        reward.alias("reward"), non_empty(F.col("exception_info")).alias("exception_info"), "path")
    d = d.withColumn("success", F.col("exception_info").isNull() & (F.col("reward") >= 1.0))
    return d.groupBy("task_name", "trial_name").agg(F.min_by(F.struct("reward", "exception_info", "success", "path"), "path").alias("r")) \
        .select("task_name", "trial_name", "r.*")


def compact_log(lines: DataFrame) -> DataFrame:
    """Plain logs without terminal noise, in chunks of 25 lines.

    ``lines``: source, line_no, value.
    """
    clean = strip(F.replace(F.regexp_replace("value", X.ANSI_PATTERN, ""), F.lit("\r"), F.lit("")))
    hashes = F.length(clean) - F.length(F.replace(clean, F.lit("#"), F.lit("")))
    d = lines.withColumn("line", clean).filter(
        (F.length("line") > 0) & ~F.col("line").rlike(X.CAST_EVENT_PATTERN) & ~F.col("line").rlike(X.PROGRESS_PATTERN)
        & ~((hashes >= 20) & F.col("line").contains("%")))
    # the patterns run once; the lines are counted and then joined with their numbers
    d = cut_lineage(d.select("source", "line_no", "line"))
    d = numbered(d, ["source"], ["line_no"], "n", F.floor(F.col("line_no") / 4096), many=True)
    d = d.withColumn("chunk", F.floor((F.col("n") - 1) / X.LOG_CHUNK_LINES))
    items = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return d.groupBy("source", "chunk").agg(F.array_join(items, "\n").alias("text"), F.count(F.lit(1)).alias("lines"))


def compact_stream(lines: DataFrame) -> DataFrame:
    """Steps of a stream log for evidence: texts, tool calls, tool results, final result."""
    d = lines.withColumn("value", strip(F.regexp_replace("value", X.ANSI_PATTERN, "")))
    d = log_lines(d).withColumn("tool_result", F.col("e.tool_use_result"))
    out = F.col("tool_result")
    streams = F.coalesce(*[non_empty(F.get_json_object(out, f"$.{k}")) for k in ("stdout", "content", "stderr")])
    blocks = d.filter(F.col("is_list")).select("trial_path", "line_no", F.col("e.type").alias("kind"), "tool_result",
                                               streams.alias("streams"), F.posexplode("blocks").alias("block", "b"))
    assistant, user = F.col("kind") == "assistant", F.col("kind") == "user"
    kind = (F.when(assistant & (F.col("b.type") == "text") & (F.length(strip(F.coalesce("b.text", F.lit("")))) > 0), "assistant_text")
            .when(assistant & (F.col("b.type") == "tool_use"), F.coalesce(non_empty(F.col("b.name")), F.lit("tool")))
            .when(user & (F.col("b.type") == "tool_result"),
                  F.when(F.coalesce("b.is_error", F.lit(False)), "tool_result_error").otherwise("tool_result")))
    payload = F.to_json(F.struct(F.coalesce(non_empty(F.col("b.name")), F.lit("tool")).alias("function_name"), F.col("b.input").alias("arguments")))
    code = (F.when(F.col("b.type") == "text", strip(F.col("b.text")))
            .when(F.col("b.type") == "tool_use", strip(F.concat(F.coalesce(strip(F.col("b.input")["description"]), F.lit("")), F.lit("\n"), payload)))
            .otherwise(strip(F.coalesce("streams", "b.content", F.lit("")))))
    rows = blocks.withColumn("action", kind).withColumn("code", code).filter(F.col("action").isNotNull() & (F.length("code") > 0)).select(
        "trial_path", "line_no", "block", "action", F.substring("code", 1, 3000).alias("code"))
    final = d.filter((F.col("e.type") == "result") & (F.length(strip(F.coalesce("e.result", F.lit("")))) > 0)).select(
        "trial_path", "line_no", F.lit(0).alias("block"), F.lit("final_result").alias("action"),
        F.substring(strip(F.col("e.result")), 1, 3000).alias("code"))
    return numbered(rows.unionByName(final), ["trial_path"], ["line_no", "block"], "step", F.floor(F.col("line_no") / 1024)).select(
        "trial_path", "step", "action", "code")


def missing_trajectories(spark: SparkSession, root: str) -> DataFrame:
    """Failed staged attempts without any raw file. Only file names are read, not contents."""
    files = read_files(spark, root, ("trajectory.json", *(p.rsplit("/", 1)[1] for p in LOG_FILES)), content=False).select("path")
    raw = files.filter(F.col("path").rlike("/(?:" + "|".join((STEP_FILE, *LOG_FILES)).replace(".", r"\.") + ")$")).select(
        F.regexp_replace("path", r"/(agent|sessions)/[^/]+$", "").alias("trial_path")).distinct()
    return manifests(spark, root).filter(~F.col("verifier_passed")).join(raw, "trial_path", "left_anti").select(
        "task_name", "attempt_number", "exception_info")
