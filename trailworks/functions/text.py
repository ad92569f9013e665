"""Text scalars of the trajectory job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .lists import contains_any, extract_all, first_match, fold_case, non_empty, squeeze, strip


def redact(text: Column) -> Column:
    """Text without credentials, absolute paths and expected-value comparisons."""
    v = F.coalesce(text, F.lit(""))
    v = F.regexp_replace(v, X.SECRET_PATTERN, X.REDACTED_CREDENTIAL)
    v = F.regexp_replace(v, X.ABSOLUTE_PATH_PATTERN, X.REDACTED_PATH)
    return F.regexp_replace(v, X.EXPECTED_VALUE_PATTERN, X.REDACTED_EXPECTED)


def _marked(text: Column, patterns) -> Column:
    for pattern, mark in patterns:
        text = F.regexp_replace(text, pattern, mark)
    return text


def redaction(text: Column) -> Column:
    """P16 as a struct of the cleaned text and whether anything changed."""
    clean = redact(text)
    return F.struct(clean.alias("text"), (clean != F.coalesce(text, F.lit(""))).alias("redacted"))


def reflection_field(text: Column, heading: str) -> Column:
    """Text under one heading, up to the next known heading, on one line."""
    def escape(name: str) -> str:
        return "".join("\\" + c if not (c.isalnum() or c == " ") else c for c in name)

    nxt = "|".join(escape(h) for h in X.REFLECTION_HEADINGS)
    pattern = rf"(?imsU)^\s*{escape(heading)}\s*:\s*(.*?)(?=^\s*(?:{nxt})\s*:|\z)"
    found = F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1)
    return F.substring(strip(squeeze(found)), 1, 2400)


def reflection_fields(text: Column) -> Column:
    """All headed fields as one struct."""
    names = ("observable", "causal_steps", "causal_evidence", "confidence",
             "root_cause", "corrective", "missing")
    return F.struct(*[reflection_field(text, h).alias(n)
                      for n, h in zip(names, X.REFLECTION_HEADINGS)])


def memory_text(text: Column) -> Column:
    return F.substring(strip(squeeze(redact(text))), 1, 2400)


def memory_fields(reflection: Column) -> Column:
    """Retrieval fields of one reflection, with fallbacks."""
    def field(h):
        return memory_text(reflection_field(reflection, h))

    evidence = field("CAUSAL EVIDENCE")
    return F.struct(
        F.coalesce(non_empty(field("FAILURE OBSERVABLE")), F.lit(X.DEFAULT_OBSERVATION)).alias("observation"),
        F.coalesce(non_empty(field("CORRECTIVE ACTION")), F.lit(X.DEFAULT_LESSON)).alias("lesson"),
        F.coalesce(non_empty(field("ROOT CAUSE")), non_empty(evidence),
                   F.lit(X.DEFAULT_RATIONALE)).alias("rationale"),
        evidence.alias("causal_evidence"),
        field("MISSING").alias("missing"),
        field("DIAGNOSIS CONFIDENCE").alias("diagnosis_confidence"),
    )


def parameterize(text: Column) -> Column:
    """Reflection text with paths, cells and numbers replaced."""
    v = redact(text)
    return F.substring(strip(squeeze(_marked(v, X.PARAMETER_PATTERNS))), 1, 600)


def cluster_text(text: Column) -> Column:
    """P20: caseless text with paths and file names masked."""
    v = strip(fold_case(F.coalesce(text, F.lit(""))))
    return F.substring(squeeze(_marked(v, X.CLUSTER_PATTERNS)), 1, 320)


def fingerprint(intent: Column, obstacle: Column) -> Column:
    """P20: order and identity of a candidate inside its pool."""
    return masked_fingerprint(cluster_text(intent), cluster_text(obstacle))


def masked_fingerprint(intent: Column, obstacle: Column) -> Column:
    """P20: fingerprint of texts that ``cluster_text`` made."""
    return F.sha2(F.concat_ws("\x1f", intent, obstacle), 256)


def embedding_text(intent: Column, obstacle: Column) -> Column:
    """Text layout that is embedded for clustering."""
    return masked_embedding_text(cluster_text(intent), cluster_text(obstacle))


def masked_embedding_text(intent: Column, obstacle: Column) -> Column:
    """Embedded text of texts that ``cluster_text`` made."""
    return F.concat(F.lit("intent: "), intent, F.lit("\nobstacle: "), obstacle)


def evidence_text(text: Column, limit: int = 900) -> Column:
    """Bounded evidence without instance literals."""
    return F.substring(strip(squeeze(_marked(F.coalesce(text, F.lit("")), X.EVIDENCE_PATTERNS))), 1, limit)


def compact_step(source: Column, message: Column, tool: Column,
                 command: Column, description: Column) -> Column:
    """Bounded view of one step; null for steps that carry nothing."""
    is_tool = F.length(F.coalesce(tool, F.lit(""))) > 0
    msg = F.coalesce(message, F.lit(""))
    kind = (
        F.when(is_tool, "tool_call")
        .when((source == "agent") & (F.length(strip(msg)) > 0), "thinking")
        .when(source == "user", "user_prompt")
    )
    desc = F.coalesce(description, F.lit(""))
    return F.when(kind.isNotNull(), F.struct(
        kind.alias("type"),
        F.when(is_tool, tool).alias("tool"),
        F.when(is_tool, F.substring(desc, 1, 200)).alias("description"),
        F.when(is_tool, F.substring(F.coalesce(non_empty(command), desc), 1, 800)).alias("command"),
        F.when(~is_tool, F.substring(msg, 1, 300)).alias("text"),
    ))


def usage(step_text: Column) -> Column:
    """P23 on one step: everything the step mentions, in order."""
    skills = F.transform(extract_all(step_text, X.SKILL_USE_PATTERN, 1), F.lower)
    return F.struct(
        F.array_distinct(skills).alias("skills"),
        F.array_distinct(extract_all(step_text, X.POLICY_USE_PATTERN, 1)).alias("policies"),
        F.array_distinct(extract_all(step_text, X.IMPLEMENTATION_USE_PATTERN, 1)).alias("implementations"),
        F.array_distinct(extract_all(step_text, X.SCRIPT_USE_PATTERN, 1)).alias("scripts"),
        F.array_distinct(extract_all(step_text, X.MEMORY_USE_PATTERN, 1)).alias("memories"),
        F.size(extract_all(step_text, X.MEMORY_QUERY_PATTERN, 1)).alias("memory_queries"),
    )


def test_names(text: Column) -> Column:
    """Test function names in a verifier script."""
    return extract_all(text, X.TEST_NAME_PATTERN, 1)


def output_artifacts(instruction: Column) -> Column:
    """Absolute paths an instruction mentions, ordered distinct."""
    raw = extract_all(instruction, X.OUTPUT_PATH_PATTERN, 1)
    return F.array_distinct(F.transform(raw, lambda p: F.regexp_replace(p, r"[.,;:)]+$", "")))


def required_capabilities(instruction: Column, source: Column) -> Column:
    """Capability labels whose words occur in the task text."""
    text = F.lower(F.concat_ws(" ", source, instruction))
    return F.filter(F.array(*[F.when(contains_any(text, words), F.lit(label))
                              for label, words in X.CAPABILITY_TERMS]), lambda c: c.isNotNull())


def constraint_lines(instruction: Column) -> Column:
    """Lines that state a constraint, bounded."""
    lines = F.transform(F.split(instruction, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip)
    hits = F.filter(lines, lambda l: (F.length(l) > 0) & contains_any(F.lower(l), X.CONSTRAINT_TERMS))
    return F.slice(F.transform(hits, lambda l: F.substring(l, 1, 300)), 1, 50)


def retrieval_tokens(text: Column) -> Column:
    """Words and CJK characters, CJK bigrams appended, stop words dropped."""
    words = extract_all(fold_case(F.coalesce(text, F.lit(""))), X.RETRIEVAL_TOKEN)
    han = F.filter(words, lambda w: w.rlike(r"^[\u3400-\u9fff]$"))
    pairs = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(han) - 1, F.lit(1))), lambda i: i < F.size(han)),
        lambda i: F.concat(F.element_at(han, i), F.element_at(han, i + 1)))
    # most texts have no such characters; the words are then found once
    all_words = F.when(text.rlike(r"[\u3400-\u9fff]"), F.concat(words, pairs)).otherwise(words)
    return F.filter(all_words, lambda w: ~w.isin(*X.RETRIEVAL_STOP_WORDS))


def _token_set(text: Column, pattern: str, stop=()) -> Column:
    words = F.array_distinct(extract_all(text, pattern))
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def audit_tokens(text: Column) -> Column:
    return _token_set(fold_case(F.coalesce(text, F.lit(""))), X.AUDIT_TOKEN, X.AUDIT_STOP_WORDS)


def distinctive_tokens(command: Column) -> Column:
    return F.filter(audit_tokens(command), lambda w: ~w.isin(*X.AUDIT_COMMON_COMMAND_WORDS))


def policy_tokens(*parts: Column) -> Column:
    return _token_set(fold_case(F.concat_ws(" ", *parts)), X.POLICY_TOKEN)


def compaction_tokens(text: Column) -> Column:
    v = _marked(fold_case(F.coalesce(text, F.lit(""))), X.COMPACTION_PATTERNS)
    words = _token_set(v, X.POLICY_TOKEN, X.COMPACTION_STOP_WORDS)
    return F.filter(words, lambda w: ~w.startswith("http"))


def section_tokens(text: Column) -> Column:
    words = F.transform(extract_all(F.coalesce(text, F.lit("")), X.SECTION_TOKEN), fold_case)
    return F.filter(F.array_distinct(words), lambda w: ~w.isin(*X.SECTION_STOP_WORDS))


def task_fingerprint(name: Column) -> Column:
    """P28"""
    return F.substring(F.sha2(name, 256), 1, 16)


def canonical_memory_id(attempt_number: Column, candidate_kind: Column, intent: Column,
                        lesson: Column, rationale: Column, retry_outcome: Column,
                        retry_transition: Column, task_family: Column, task_name: Column) -> Column:
    """Hash of the compact JSON of the sorted identity fields, nulls kept."""
    payload = F.to_json(F.struct(
        attempt_number.alias("attempt_number"), candidate_kind.alias("candidate_kind"),
        intent.alias("intent"), lesson.alias("lesson"), rationale.alias("rationale"),
        retry_outcome.alias("retry_outcome"), retry_transition.alias("retry_transition"),
        task_family.alias("task_family"), task_name.alias("task_name"),
    ), {"ignoreNullFields": "false"})
    return F.concat(F.lit("memory-"), F.substring(F.sha2(payload, 256), 1, 20))


def instruction_kind(text: Column) -> Column:
    """P30"""
    low = fold_case(text)
    return first_match([
        ("validation", contains_any(low, X.VALIDATION_TERMS)),
        ("planning", contains_any(low, X.PLANNING_TERMS)),
        ("checking", contains_any(low, X.CHECKING_TERMS)),
    ])


def slug(text: Column) -> Column:
    v = F.regexp_replace(fold_case(text), r"[^a-z0-9]+", "-")
    v = F.substring(F.regexp_replace(v, r"^-+|-+$", ""), 1, 64)
    return F.coalesce(non_empty(v), F.lit("section"))
