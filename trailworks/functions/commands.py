"""Command normalization."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .errors import candidate_error_type, trace_error_type
from .lists import contains_any, extract_all, first_match, non_empty, squeeze, strip

def file_paths(text: Column) -> Column:
    """Path-like words with a known extension, ordered distinct."""
    return F.array_distinct(extract_all(text, X.PATH_PATTERN))


def written_paths(command: Column) -> Column:
    """P5: paths inside any fragment of the command that writes a file."""
    hits = F.concat(*[extract_all(command, p) for p in X.WRITE_PATTERNS])
    return file_paths(F.array_join(hits, "\n"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def suffix(path: Column) -> Column:
    """Lower-case extension of the last path component, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)/*$", 1))


def suffixes(paths: Column) -> Column:
    """Sorted distinct extensions of a path list."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(paths, suffix), lambda s: s != "")))


def target(paths: Column, fallback: Column) -> Column:
    """``*.ext`` of the first suffixed path, else its name, else masked text."""
    ext = F.get(F.filter(F.transform(paths, suffix), lambda s: s != ""), 0)
    masked = F.lower(strip(F.coalesce(fallback, F.lit(""))))
    masked = F.regexp_replace(masked, r"['\"][^'\"]{1,120}['\"]", "<quoted>")
    masked = squeeze(F.regexp_replace(masked, r"(?U)\b\d+\b", "<num>"))
    return F.coalesce(
        F.concat(F.lit("*."), ext),
        F.substring(F.lower(base_name(F.get(paths, 0))), 1, 80),
        non_empty(F.substring(masked, 1, 80)))


def plain_command(command: Column) -> Column:
    """Lower-case command without outer white space; stage it, every rule below reads it."""
    return F.lower(strip(F.coalesce(command, F.lit(""))))


def bash_action(low: Column, written: Column) -> Column:
    """Action family of a shell command, first matching rule wins.

    ``low``: ``plain_command`` of it, ``written``: P5 of it.
    """
    first = F.regexp_extract(low, r"(?U)^\s*(\S+)", 1)
    writes = F.size(written) > 0
    # what a label asks for besides its pattern, or instead of it
    also = {"write_spreadsheet": lambda hit: hit & writes, "write_file": lambda _: writes,
            "read_file": lambda hit: hit | first.isin(*X.READ_COMMANDS), "edit_file": lambda hit: hit | low.contains(X.PATCH_COMMAND),
            "inspect_failure": lambda _: contains_any(low, X.FAILURE_WORDS)}
    rules = [(label, also.get(label, lambda hit: hit)(low.rlike(pattern) if pattern else None)) for label, pattern in X.ACTION_PATTERNS]
    return first_match(rules, "other_command")


def tool_action(tool: Column, low: Column, written: Column) -> Column:
    """P10: action before the failure remap."""
    return (
        F.when(tool == "Bash", bash_action(low, written))
        .when(tool.isin("Read", "NotebookRead"), "read_file")
        .when(tool == "Edit", "edit_file")
        .when(tool.isin("Write", "NotebookEdit"), "write_file")
        .when(tool.isin("Grep", "Glob"), "search_text")
        .otherwise("other_tool")
    )


def target_paths(tool: Column, paths: Column, written: Column, inputs: Column, outputs: Column,
                 action: Column) -> Column:
    """The files a call is about; writers look at what they wrote first."""
    return (
        F.when(tool == "Bash", F.when(action.isin("write_spreadsheet", "write_file"), written).otherwise(paths))
        .when(tool.isin("Edit", "Write", "NotebookEdit"), F.when(F.size(outputs) > 0, outputs).otherwise(inputs))
        .when(tool.isin("Read", "NotebookRead", "Grep", "Glob"), inputs)
        .otherwise(F.concat(inputs, outputs))
    )


def target_fallback(tool: Column, low: Column, description: Column, paths: Column, action: Column) -> Column:
    """Text used without files; null where no target is wanted."""
    unknown = action == "other_command"
    text = low
    return (
        F.when(tool != "Bash", description)
        .when(unknown & (F.size(paths) == 0), F.lit(None).cast("string"))
        .when(unknown, F.coalesce(non_empty(description), text))
        .otherwise(text)
    )


def action_after_failure(action: Column, success: Column) -> Column:
    """P10: failed commands without a better label become ``inspect_failure``."""
    return F.when(~success & action.isin("other_command", "other_tool"), "inspect_failure").otherwise(action)


def action_cost(action: Column, success: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in X.ACTION_COST.items() for v in pair])
    base = F.coalesce(F.try_element_at(table, action), F.lit(X.DEFAULT_ACTION_COST))
    return base + F.when(~success, X.FAILURE_SURCHARGE).otherwise(0.0)


def event_error_type(message: Column) -> Column:
    return F.when(F.length(message) > 0, trace_error_type(message)).otherwise("")


def command_shape(text: Column) -> Column:
    """The command with task-specific values replaced."""
    v = strip(F.coalesce(text, F.lit("")))
    for pattern, mark in X.COMMAND_SHAPE_PATTERNS:
        v = F.regexp_replace(v, pattern, mark)
    return F.substring(strip(squeeze(v)), 1, 320)


def call_text(command: Column, description: Column) -> Column:
    """The command of a call, else its description."""
    return strip(F.coalesce(non_empty(command), description, F.lit("")))


def attempt_shape(tool: Column, command: Column, description: Column, message: Column) -> Column:
    """What counts as the same failed attempt."""
    v = F.lower(call_text(command, description))
    for pattern, mark in X.ATTEMPT_SHAPE_PATTERNS:
        v = F.regexp_replace(v, pattern, mark)
    return F.struct(
        F.lower(tool).alias("tool"),
        F.substring(squeeze(v), 1, 240).alias("command"),
        candidate_error_type(message).alias("error_type"),
    )


def is_meaningful_success(success: Column, command: Column, description: Column) -> Column:
    """A success that is not a trivial look-around command."""
    text = F.lower(call_text(command, description))
    word = F.regexp_extract(text, r"(?U)^(\S+)", 1)
    return success & (F.length(text) > 0) & ~word.isin(*X.TRIVIAL_COMMANDS)


def is_public_action(action: Column) -> Column:
    """No component of ``a -> b`` is an internal primitive."""
    parts = F.transform(F.split(F.coalesce(action, F.lit("")), "->"), strip)
    return ~F.exists(parts, lambda p: p.isin(*X.INTERNAL_ACTIONS))
