"""Error detection and the two error classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .lists import contains_any, extract_all, first_match, matches_any, non_empty, strip


def result_text(truncated: Column, content: Column, raw_content: Column,
                stdout: Column, stderr: Column) -> Column:
    """The first filled result field, else stdout and stderr joined."""
    streams = strip(F.array_join(F.filter(F.array(stdout, stderr), lambda s: F.length(s) > 0), "\n"))
    return F.coalesce(non_empty(truncated), non_empty(content), non_empty(raw_content),
                      streams, F.lit(""))


def is_error(flag: Column, meta_flag: Column, result: Column) -> Column:
    """Flags first, then a non-zero exit code, then markers in the result text."""
    text = F.coalesce(result, F.lit(""))
    lower = F.lower(text)
    codes = extract_all(text, X.EXIT_CODE_PATTERN, 1)
    return (
        F.coalesce(flag, F.lit(False))
        | F.coalesce(meta_flag, F.lit(False))
        | F.exists(codes, lambda c: c.rlike("[1-9]"))
        | contains_any(text, X.ERROR_MARKERS)
        | matches_any(lower, X.LOOSE_ERROR_PATTERNS)
        | (lower.contains("assert ") & contains_any(lower, ("false", "fail")))
    )


def trace_error_type(message: Column) -> Column:
    """Label used on trace events."""
    text = F.lower(F.coalesce(message, F.lit("")))
    exit_code = F.regexp_extract(text, X.TRACE_EXIT_PATTERN, 1)
    rules = [(label, contains_any(text, words)) for label, words in X.TRACE_ERROR_LABELS]
    rules.append(("non_zero_exit", exit_code.rlike("[1-9]")))
    return first_match(rules, "unknown")


def candidate_error_type(message: Column) -> Column:
    """Label used on recovery candidates; deliberately not P6."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return first_match([
        ("syntax", contains_any(text, ("syntax", "indentation"))),
        ("transient", contains_any(text, ("timeout", "connection"))
         | text.rlike(X.TRANSIENT_STATUS_PATTERN)),
        ("missing_file", contains_any(text, ("no such file", "filenotfound"))),
        ("not_found", contains_any(text, ("modulenotfounderror", "importerror", "command not found"))),
        ("data_obstacle", contains_any(text, X.OBSTACLE_WORDS)),
        ("validation", contains_any(text, ("assert", "failed"))),
        ("permission", text.contains("permission")),
        ("runtime", F.length(text) > 0),
    ], "unknown")
