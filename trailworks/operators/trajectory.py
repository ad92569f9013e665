"""Step logs to tool calls, segments, artifacts, failure spans and substeps
(SURVEY P3, P10, W1-W6, A7, A8, K3, K4).

``steps``: task_family, task_name, attempt_number, step_idx, source, message, tool_name,
args MAP<STRING,STRING>, result_text, is_error BOOLEAN (explicit flag, nullable).
``attempts``: task_family, task_name, attempt_number, verifier_passed, reflection, ...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import commands as C
from ..functions import errors as E
from ..functions import fixed as X
from ..functions.lists import contains_any, non_empty, strip
from ..functions.staging import staged
from ..functions.text import usage
from ..functions.sequence import first_rows, following_within, running_sum, step_chunk

ATTEMPT = ["task_family", "task_name", "attempt_number"]
CALL = [*ATTEMPT, "step_idx", "tool_name", "command", "description", "input_files", "output_files",
        "success", "error_message"]


def tool_calls(steps: DataFrame) -> DataFrame:
    """One row per tool call with command, files and success."""
    arg = lambda name: F.coalesce(F.col("args")[name], F.lit(""))
    tool = F.col("tool_name")
    path = arg("file_path")
    one = F.when(F.length(path) > 0, F.array(path)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    bash_paths, written = F.col("_paths"), F.col("_written")
    other = F.coalesce(F.col("args")["file_path"], F.col("args")["path"], F.lit(""))
    failed = E.is_error(F.col("is_error"), F.lit(None).cast("boolean"), F.col("result_text"))
    return (
        # the path patterns are plain columns, so that plans which do not ask for files leave them out
        staged(steps.filter(F.length(tool) > 0), failed=failed)
        .withColumn("_paths", F.when(tool == "Bash", C.file_paths(arg("command"))))
        .withColumn("_written", F.when(tool == "Bash", C.written_paths(arg("command"))))
        .select(
            *ATTEMPT, "step_idx", "tool_name",
            F.when(tool == "Bash", arg("command")).when(tool == "Write", arg("content"))
            .otherwise("").alias("command"),
            F.when(tool == "Bash", arg("description"))
            .when(tool == "Read", F.concat(F.lit("Read "), path))
            .when(tool == "Write", F.concat(F.lit("Write → "), path))
            .when(tool == "Edit", F.concat(F.lit("Edit "), path))
            .otherwise(F.coalesce(F.col("args")["description"], arg("command"))).alias("description"),
            F.when(tool == "Bash", F.array_except(bash_paths, written))
            .when(tool.isin("Read", "Edit"), one).when(tool == "Write", none)
            .otherwise(F.when(F.length(other) > 0, F.array(other)).otherwise(none)).alias("input_files"),
            F.when(tool == "Bash", F.array_intersect(bash_paths, written))
            .when(tool.isin("Write", "Edit"), one).otherwise(none).alias("output_files"),
            (~F.col("failed")).alias("success"),
            F.when(F.col("failed"), F.coalesce(F.col("result_text"), F.lit(""))).otherwise("")
            .alias("error_message"),
        )
    )


def attempt_usage(steps: DataFrame, text: Column | None = None) -> DataFrame:
    """P23 per attempt, long form: what an attempt used, with the step that first named it.

    ``text``: what is searched; by default message, arguments and result of a step as JSON.
    """
    body = F.to_json(F.struct("message", "args", "result_text")) if text is None else text
    d = staged(steps, _u=usage(body))
    kinds = ("skills", "policies", "implementations", "scripts", "memories")

    def tagged(kind: str) -> Column:
        return F.transform(F.col(f"_u.{kind}"), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("used_id")))

    named = F.flatten(F.array(*[tagged(k) for k in kinds]))
    return d.select(*ATTEMPT, "step_idx", F.inline(named)).groupBy(*ATTEMPT, "kind", "used_id").agg(
        F.min("step_idx").alias("first_step"))


def memory_queries(steps: DataFrame, text: Column | None = None) -> DataFrame:
    """Number of memory look-ups per attempt."""
    body = F.to_json(F.struct("message", "args", "result_text")) if text is None else text
    return steps.groupBy(*ATTEMPT).agg(F.sum(usage(body)["memory_queries"]).alias("memory_query_count"))


def error_events(calls: DataFrame) -> DataFrame:
    """Failed calls with the trace error label."""
    return calls.filter(~F.col("success")).select(
        *ATTEMPT, "step_idx", "tool_name", "error_message",
        E.trace_error_type(F.col("error_message")).alias("error_type"))


def normalized_events(calls: DataFrame) -> DataFrame:
    """P10: stable action token, target, signature, error label and cost per call."""
    tool, cmd = F.col("tool_name"), F.col("command")
    none = F.array().cast("array<string>")
    d = staged(calls, _paths=F.when(tool == "Bash", C.file_paths(cmd)).otherwise(none),
               _written=F.when(tool == "Bash", C.written_paths(cmd)).otherwise(none),
               _low=C.plain_command(cmd))
    d = staged(d, _action=C.tool_action(tool, F.col("_low"), F.col("_written")))
    d = staged(
        d, action=C.action_after_failure(F.col("_action"), F.col("success")),
        target=C.target(
            C.target_paths(tool, F.col("_paths"), F.col("_written"), F.col("input_files"), F.col("output_files"), F.col("_action")),
            C.target_fallback(tool, F.col("_low"), F.col("description"), F.col("_paths"), F.col("_action"))))
    return d.select(
        *ATTEMPT, "step_idx", "tool_name", "command", "description", "input_files", "output_files",
        "success", "error_message",
        F.substring(F.coalesce(non_empty(F.col("command")), F.col("description")), 1, 1000).alias("raw_text"),
        "action", "target",
        F.concat_ws(":", F.col("action"), F.coalesce(F.col("target"), F.lit("any"))).alias("signature_token"),
        C.event_error_type(F.col("error_message")).alias("error_type"),
        C.action_cost(F.col("action"), F.col("success")).alias("cost"),
    )


# --- thinking segments --------------------------------------------------------------------

MARKER_REACH = 32      # longer than any marker
MARKER_MESSAGES = 16   # that many non-empty messages cover the reach
TEXT_CAP = 2000


def _island_chunks(messages: DataFrame) -> DataFrame:
    """Text of each (island, chunk of steps): bounded rows that merge in order."""
    key = [*ATTEMPT, "island", "_chunk"]
    items = F.array_sort(F.collect_list(F.struct("step_idx", "text")))
    return messages.groupBy(*key).agg(
        F.array_join(F.transform(items, lambda x: x["text"]), " ").alias("text"))


def thinking_segments(steps: DataFrame) -> DataFrame:
    """Runs of agent text between two tool calls; user steps do not break a run."""
    tool = F.length(F.coalesce(F.col("tool_name"), F.lit(""))) > 0
    slim = steps.select(*ATTEMPT, "step_idx", "source", "message", tool.alias("is_tool"))
    marked = running_sum(slim, ATTEMPT, "step_idx", F.col("is_tool").cast("int"), "island")
    ends = marked.groupBy(*ATTEMPT, "island").agg(
        F.min(F.when(~F.col("is_tool") & (F.col("source") == "agent"), F.col("step_idx"))).alias("start_step"),
        F.max("step_idx").alias("_last"))
    totals = steps.groupBy(*ATTEMPT).agg(F.max("step_idx").alias("_total"))
    # An island ends before the next tool call: the first step of the following island.
    last_island = marked.groupBy(*ATTEMPT).agg(F.max("island").alias("_final"))
    spans = (
        ends.filter(F.col("start_step").isNotNull())
        .join(totals.join(last_island, ATTEMPT), ATTEMPT)
        .withColumn("end_step", F.when(F.col("island") == F.col("_final"), F.col("_total"))
                    .otherwise(F.col("_last")))
    )
    messages = (
        marked.filter(~F.col("is_tool") & (F.col("source") == "agent"))
        .select(*ATTEMPT, "island", "step_idx", step_chunk("step_idx", 256).alias("_chunk"),
                strip(F.coalesce(F.col("message"), F.lit(""))).alias("text"))
        .filter(F.length("text") > 0)
    )
    chunks = _island_chunks(messages)
    order = Window.partitionBy(*ATTEMPT, "island").orderBy("_chunk")
    tails = F.collect_list(F.right(F.col("text"), F.lit(MARKER_REACH))).over(
        order.rowsBetween(-MARKER_MESSAGES, -1))
    seen = F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    pieces = chunks.withColumn("_seen", F.coalesce(seen, F.lit(0))).withColumn(
        "_look", F.lower(F.array_join(F.concat(tails, F.array("text")), " ")))
    flags = pieces.groupBy(*ATTEMPT, "island").agg(
        F.array_sort(F.collect_list(F.when(
            F.col("_seen") < TEXT_CAP,
            F.struct("_chunk", F.substring("text", 1, TEXT_CAP).alias("text"))))).alias("_parts"),
        F.bool_or(contains_any(F.col("_look"), X.RETRY_MARKERS)).alias("suggests_retry"),
        F.bool_or(contains_any(F.col("_look"), X.FIX_MARKERS)).alias("mentions_fix"),
        F.bool_or(contains_any(F.col("_look"), X.ALTERNATIVE_MARKERS)).alias("mentions_alternative"),
    )
    no = F.lit(False)
    return spans.join(flags, [*ATTEMPT, "island"], "left").select(
        *ATTEMPT, "start_step", "end_step",
        F.coalesce(F.substring(F.array_join(F.transform("_parts", lambda x: x["text"]), " "), 1, TEXT_CAP),
                   F.lit("")).alias("text"),
        F.coalesce("suggests_retry", no).alias("suggests_retry"),
        F.coalesce("mentions_fix", no).alias("mentions_fix"),
        F.coalesce("mentions_alternative", no).alias("mentions_alternative"),
    )


# --- artifacts ----------------------------------------------------------------------------

def artifact_touches(calls: DataFrame) -> DataFrame:
    """A7 long form: one row per call and artifact, with what the call did to it."""
    flagged = F.transform(
        F.array_distinct(F.concat("input_files", "output_files")),
        lambda p: F.struct(p.alias("path"), F.array_contains(F.col("output_files"), p).alias("produced"),
                           F.array_contains(F.col("input_files"), p).alias("consumed")))
    pos = calls.select(*ATTEMPT, "step_idx", F.posexplode(flagged).alias("_pos", "f"))
    return pos.select(*ATTEMPT, F.lower(C.base_name(F.col("f.path"))).alias("artifact"),
                      F.col("f.path").alias("path"), "step_idx", "_pos",
                      F.col("f.produced").alias("produced"), F.col("f.consumed").alias("consumed"))


def artifacts(calls: DataFrame) -> DataFrame:
    """Life of each artifact of an attempt. The step lists stay in the long form."""
    n_out, n_in = F.count_if(F.col("produced")), F.count_if(F.col("consumed"))
    return artifact_touches(calls).groupBy(*ATTEMPT, "artifact").agg(
        F.min_by("path", F.struct("step_idx", "_pos")).alias("path"),
        F.min("step_idx").alias("first_step"), F.max("step_idx").alias("last_step"),
        n_out.alias("times_produced"), n_in.alias("times_consumed"),
    ).withColumn("ext", C.suffix(F.col("path"))).withColumn(
        "role", F.when((F.col("times_produced") > 0) & (F.col("times_consumed") == 0), "output")
        .when((F.col("times_consumed") > 0) & (F.col("times_produced") == 0), "input")
        .otherwise("intermediate"))


def artifact_revisits(calls: DataFrame) -> DataFrame:
    """Artifacts touched by at least two calls."""
    names = F.array_distinct(F.transform(F.concat("input_files", "output_files"),
                                         lambda p: F.lower(C.base_name(p))))
    return (
        calls.select(*ATTEMPT, F.explode(names).alias("artifact"))
        .groupBy(*ATTEMPT, "artifact").agg(F.count(F.lit(1)).alias("touches"))
        .filter(F.col("touches") >= 2)
    )


# --- failure spans ------------------------------------------------------------------------

def _span_rows(calls: DataFrame) -> DataFrame:
    """Calls that belong to a failure span, numbered by the closers before them."""
    closer = C.is_meaningful_success(F.col("success"), F.col("command"), F.col("description"))
    d = calls.withColumn("is_closer", closer)
    d = running_sum(d, ATTEMPT, "step_idx", F.col("is_closer").cast("int"), "span", inclusive=False)
    return d.filter(~F.col("success") | F.col("is_closer"))


def span_failures(calls: DataFrame) -> DataFrame:
    """Every failed call of a span: the ordered ``failed_attempts`` of a candidate, long form."""
    return _span_rows(calls).filter(~F.col("success")).select(
        *ATTEMPT, "span", "step_idx", "tool_name",
        C.call_text(F.col("command"), F.col("description")).alias("command"), "error_message",
        E.candidate_error_type(F.col("error_message")).alias("error_type"))


def failure_spans(calls: DataFrame) -> DataFrame:
    """One row per span with its failures and closing call.

    Distinct failures are counted over (span, normalized failure) groups first, so that
    no span is ever collected whole.
    """
    text = C.call_text(F.col("command"), F.col("description"))
    rows = _span_rows(calls).select(
        *ATTEMPT, "span", "step_idx", "success", "tool_name", text.alias("_text"),
        C.attempt_shape(F.col("tool_name"), F.col("command"), F.col("description"),
                        F.col("error_message")).alias("_shape"),
        # A failed command is compared with its blanks collapsed, the winner as it stands.
        F.when(F.col("success"), F.lower(text)).otherwise(
            strip(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))).alias("_cmd"),
    )
    fail = ~F.col("success")
    by_shape = rows.groupBy(*ATTEMPT, "span", "_cmd", F.when(fail, F.col("_shape")).alias("_shape")).agg(
        F.count_if(fail).alias("_fails"),
        F.min(F.when(fail, F.col("step_idx"))).alias("_first_fail"),
        F.max(F.when(fail, F.col("step_idx"))).alias("_last_fail"),
        F.max(F.when(~fail, F.struct("step_idx", "tool_name", "_text"))).alias("_winner"),
    )
    by_cmd = by_shape.groupBy(*ATTEMPT, "span", "_cmd").agg(
        F.sum("_fails").alias("_fails"), F.min("_first_fail").alias("_first_fail"),
        F.max("_last_fail").alias("_last_fail"), F.max("_winner").alias("_winner"),
        ((F.sum("_fails") > 0) & F.max("_winner").isNotNull()).alias("_repeated"),
    )
    # Different raw commands can share a shape: count shapes, not commands.
    shapes = (
        by_shape.filter(F.col("_shape").isNotNull()).groupBy(*ATTEMPT, "span", "_shape")
        .agg(F.lit(1).alias("_one"))
        .groupBy(*ATTEMPT, "span").agg(
            F.sum("_one").alias("distinct_failures"),
            F.array_sort(F.collect_set(F.col("_shape.error_type"))).alias("error_types"))
    )
    spans = by_cmd.groupBy(*ATTEMPT, "span").agg(
        F.sum("_fails").alias("failures"), F.min("_first_fail").alias("first_step"),
        F.max("_last_fail").alias("_last_fail"), F.max("_winner").alias("_winner"),
        F.bool_or("_repeated").alias("winner_was_tried"))
    return (
        spans.filter(F.col("failures") > 0).join(shapes, [*ATTEMPT, "span"])
        .select(
            *ATTEMPT, "span", "failures", "distinct_failures", "error_types", "first_step",
            F.coalesce(F.col("_winner.step_idx"), F.col("_last_fail")).alias("last_step"),
            F.col("_winner").isNotNull().alias("resolved"),
            F.coalesce(F.col("_winner.tool_name"), F.lit("")).alias("winning_tool"),
            F.coalesce(F.col("_winner._text"), F.lit("")).alias("winning_command"),
            F.coalesce("winner_was_tried", F.lit(False)).alias("winner_was_tried"))
    )


CANDIDATE = [
    "candidate_id", "task_family", "task_name", "attempt_number", "first_step", "last_step",
    "winning_tool", "winning_command", "exploration_cost", "intent", "obstacle", "resolution",
    "evidence_label", "evidence_source", "retry_outcome", "candidate_kind",
]


def _candidate_id(source: str, number: Column) -> Column:
    return F.concat_ws(":", F.col("task_name"), F.col("attempt_number").cast("string"),
                       F.concat(F.lit(f"{source}-"), number.cast("string")))


def span_candidates(calls: DataFrame, attempts: DataFrame, min_cost: int = 2) -> DataFrame:
    """Spans that cost enough and are worth remembering."""
    spans = failure_spans(calls)
    cost = F.col("distinct_failures") + F.col("resolved").cast("int")
    needed = F.when(F.col("resolved"), min_cost).otherwise(max(1, min_cost - 1))
    incidental = F.array(*[F.lit(x) for x in X.INCIDENTAL_ERRORS])
    kept = spans.withColumn("exploration_cost", cost).filter(
        (F.col("exploration_cost") >= needed)
        & (F.size(F.array_except("error_types", incidental)) > 0)
        & ~F.col("winner_was_tried"))
    return kept.join(attempts.select(*ATTEMPT, "verifier_passed"), ATTEMPT).select(
        _candidate_id("span", F.col("span")).alias("candidate_id"), *ATTEMPT,
        "first_step", "last_step", "winning_tool", "winning_command", "exploration_cost",
        F.concat(F.lit("resolve processing obstacle with "),
                 F.coalesce(non_empty(F.col("winning_tool")), F.lit("an alternative approach"))).alias("intent"),
        F.array_join("error_types", "; ").alias("obstacle"),
        F.when(F.col("resolved"), F.concat(F.lit("Use the verified "), F.col("winning_tool"),
                                           F.lit(" approach and validate its output.")))
        .otherwise("Investigate the obstacle before committing to an implementation.").alias("resolution"),
        F.when(F.col("verifier_passed"), "verified_success")
        .when(F.col("resolved"), "tool_recovery").otherwise("unresolved_failure").alias("evidence_label"),
        F.lit("trajectory").alias("evidence_source"), F.lit(None).cast("string").alias("retry_outcome"),
        F.lit("recovery_candidate").alias("candidate_kind"),
    )


# --- reusable substeps --------------------------------------------------------------------

def atomic_substeps(events: DataFrame) -> DataFrame:
    """Successful calls with a known action, with their signature."""
    ins, outs = F.col("input_formats"), F.col("output_formats")
    d = staged(events.filter(F.col("success") & ~F.col("action").isin("other_command", "other_tool")),
               input_formats=C.suffixes(F.col("input_files")), output_formats=C.suffixes(F.col("output_files")))
    return d.select(
        *ATTEMPT, "step_idx", "action", "tool_name", "target",
        F.concat(F.col("action"), F.lit(":"), F.coalesce("target", F.lit("any")), F.lit(":"),
                 F.array_join(ins, ","), F.lit("->"), F.array_join(outs, ",")).alias("signature"),
        C.command_shape(F.coalesce(non_empty(F.col("command")), F.col("description"))).alias("command_shape"),
        ins, outs)


def workflow_bigrams(atoms: DataFrame, max_gap: int = 4) -> DataFrame:
    """Neighbouring atoms with different actions and a small step gap."""
    cols = ["step_idx", "action", "tool_name", "target", "signature", "command_shape",
            "input_formats", "output_formats"]
    d = following_within(atoms, ATTEMPT, "step_idx", F.struct(*cols), "r", max_gap)
    d = d.filter(F.col("r.action") != F.col("action"))
    merged = lambda c: F.array_sort(F.array_distinct(F.concat(c, F.col(f"r.{c}"))))
    return d.select(
        *ATTEMPT, F.col("step_idx").alias("first_step"), F.col("r.step_idx").alias("last_step"),
        F.concat_ws(" -> ", "action", "r.action").alias("action"),
        F.concat_ws("+", "tool_name", "r.tool_name").alias("tool_name"),
        F.coalesce("r.target", "target").alias("target"),
        F.concat(F.lit("workflow:"), F.col("signature"), F.lit("->"), F.col("r.signature")).alias("signature"),
        F.array_join(F.filter(F.array("command_shape", "r.command_shape"), lambda s: F.length(s) > 0),
                     " -> ").alias("command_shape"),
        merged("input_formats").alias("input_formats"), merged("output_formats").alias("output_formats"))


def substeps(events: DataFrame) -> DataFrame:
    """W4 and W5 as one table."""
    atoms = atomic_substeps(events)
    a = atoms.select(*ATTEMPT, F.lit("atomic").alias("kind"), F.col("step_idx").alias("first_step"),
                     F.col("step_idx").alias("last_step"), "action", "tool_name", "target", "signature",
                     "command_shape", "input_formats", "output_formats")
    return a.unionByName(workflow_bigrams(atoms).withColumn("kind", F.lit("workflow")))


def distinct_substeps(subs: DataFrame, attempts: DataFrame) -> DataFrame:
    """K3: substeps of passing attempts, first one per (task, signature)."""
    passing = attempts.filter("verifier_passed").select(*ATTEMPT)
    cols = [c for c in subs.columns if c not in ("task_name", "signature")]
    order = F.struct("attempt_number", (F.col("kind") == "workflow").alias("w"), "first_step")
    return (
        subs.join(passing, ATTEMPT, "left_semi")
        .groupBy("task_name", "signature").agg(F.min_by(F.struct(*cols), order).alias("s"))
        .select("task_name", "signature", "s.*")
    )


def substep_candidates(unique: DataFrame) -> DataFrame:
    """K4 part: verifier-backed substeps as candidates."""
    workflow = F.col("kind") == "workflow"
    label = F.when(workflow, "workflow").otherwise("atomic operation")
    return unique.select(
        _candidate_id("substep", F.substring(F.sha2("signature", 256), 1, 12)).alias("candidate_id"),
        *ATTEMPT, "first_step", "last_step", F.col("tool_name").alias("winning_tool"),
        F.col("command_shape").alias("winning_command"),
        F.when(workflow, 2).otherwise(1).alias("exploration_cost"),
        F.concat(F.lit("reuse a cross-format "), label, F.lit(": "), F.col("action")).alias("intent"),
        F.concat(F.lit("recurring "), F.col("action"),
                 F.lit(" step with normalized artifact boundaries")).alias("obstacle"),
        F.concat(F.lit("Apply the parameterized "), F.col("action"),
                 F.lit(" step and preserve its normalized input/output field types before continuing."))
        .alias("resolution"),
        F.lit("verified_success").alias("evidence_label"), F.lit("trajectory").alias("evidence_source"),
        F.lit(None).cast("string").alias("retry_outcome"),
        F.when(workflow, "workflow").otherwise("atomic_substep").alias("candidate_kind"))


# --- final failures -----------------------------------------------------------------------

def last_failures(calls: DataFrame, attempts: DataFrame, reason: str, n: int = 3) -> DataFrame:
    """The last three failed calls per attempt, or one verifier row if there is none."""
    failed = calls.filter(~F.col("success")).select(
        *ATTEMPT, "step_idx", "tool_name",
        C.call_text(F.col("command"), F.col("description")).alias("command"), "error_message",
        E.candidate_error_type(F.col("error_message")).alias("error_type"))
    last = first_rows(failed, ATTEMPT, [F.desc("step_idx")], n)
    missing = attempts.select(*ATTEMPT).join(failed, ATTEMPT, "left_anti").select(
        *ATTEMPT, F.lit(0).cast(calls.schema["step_idx"].dataType).alias("step_idx"),
        F.lit("verifier").alias("tool_name"), F.lit("final artifact verification").alias("command"),
        F.lit(reason).alias("error_message"), F.lit("validation").alias("error_type"))
    return last.join(attempts.select(*ATTEMPT), ATTEMPT, "left_semi").unionByName(missing)


def rejection_candidates(calls: DataFrame, attempts: DataFrame) -> DataFrame:
    """K4 part: every attempt the verifier rejected stays as a hypothesis."""
    rejected = attempts.filter(~F.col("verifier_passed"))
    tail = last_failures(calls, rejected, "final verifier rejected the artifact")
    agg = tail.groupBy(*ATTEMPT).agg(F.min("step_idx").alias("first_step"), F.max("step_idx").alias("last_step"),
                                     F.count(F.lit(1)).alias("exploration_cost"))
    return agg.select(
        _candidate_id("rejection", F.lit(1)).alias("candidate_id"), *ATTEMPT, "first_step", "last_step",
        F.lit("").alias("winning_tool"), F.lit("").alias("winning_command"), "exploration_cost",
        F.lit("diagnose a verifier-rejected artifact against the task contract").alias("intent"),
        F.lit("unexplained verifier rejection").alias("obstacle"),
        F.lit("Create a parameterized diagnostic that reports contract violations before final submission.")
        .alias("resolution"),
        F.lit("unresolved_failure").alias("evidence_label"), F.lit("trajectory").alias("evidence_source"),
        F.lit(None).cast("string").alias("retry_outcome"), F.lit("recovery_candidate").alias("candidate_kind"))
