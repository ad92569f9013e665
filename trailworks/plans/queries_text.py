"""Text scalar queries over documents, pages and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as CLN
from ..functions import feedback as FB
from ..functions import fixed as X
from ..functions import text as T
from ..operators import compaction as CP
from ..operators import policies as P
from ..sources import tables as TB
from ..sources import trajectories as S
from .catalog import query
from .views import table


def _noted(spark, sf):
    """Documents with a credential, a path and an expected value appended to the whole text."""
    k = F.col("doc_id").cast("string")
    note = F.concat(F.lit("\napi_key=k"), k, F.lit(" see /srv/data/"), k, F.lit("/f.csv and /tmp\nexpected "), k, F.lit(" got 4\n"))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.col("text"), note).alias("text"))


REDACT_SQL = """regexp_replace(regexp_replace(regexp_replace(t, '(?i)(?:api[_-]?key|token|secret|password)\\s*[=:]\\s*\\S+', '[redacted credential]', 'g'),
  '(^|[^\\w])/(?:[^\\s`''"]+/)+[^\\s`''"]+', '\\1[redacted path]', 'g'), '(?i)(?:expected|want|should be|must equal)\\s+[^\\n]{1,240}(?:\\s+(?:got|actual|received)\\s+[^\\n]{1,240})?', '[redacted expected-value comparison]', 'g')"""


@query("redaction", f"""WITH n AS (SELECT doc_id, text || chr(10) || 'api_key=k' || doc_id || ' see /srv/data/' || doc_id || '/f.csv and /tmp' || chr(10) || 'expected ' || doc_id || ' got 4' || chr(10) AS t FROM documents)
 SELECT doc_id, sha256({REDACT_SQL}) AS digest, {REDACT_SQL} <> t AS redacted FROM n""")
def redaction(spark, sf):
    d = _noted(spark, sf).withColumn("r", T.redaction(F.col("text")))
    return d.select("doc_id", F.sha2("r.text", 256).alias("digest"), F.col("r.redacted").alias("redacted"))


@query("evidence_text", """WITH n AS (SELECT doc_id, text || ' /srv/data/' || doc_id || '/f.csv 12345' AS t FROM documents)
 SELECT doc_id, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?:[A-Za-z]:)?(?:/|\\\\)(?:[^\\s/\\\\]+(?:/|\\\\))+[^\\s]*', '<path>', 'g'), '\\b\\d{4,}(?:\\.\\d+)?\\b', '<value>', 'g'),
  '\\b[A-Fa-f0-9]{24,}\\b', '<token>', 'g'), '\\s+', ' ', 'g')), 900) AS evidence FROM n""")
def evidence_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.col("text"), F.lit(" /srv/data/"), F.col("doc_id").cast("string"), F.lit("/f.csv 12345")).alias("t"))
    return d.select("doc_id", T.evidence_text(F.col("t")).alias("evidence"))


@query("document_quality", """WITH d AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda l: trim(l, E' \\t')), lambda l: l <> '') AS lines FROM documents)
 SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS word_count, len(lines) AS nonempty_lines, len(lines) - len(list_distinct(lines)) AS duplicate_nonempty_lines,
  len(regexp_extract_all(text, '\\]\\((references/policies/[^)#]+\\.md)\\)')) AS policy_links FROM d""")
def document_quality(spark, sf):
    d = P.document_quality(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", *[F.col(c).cast("long").alias(c) for c in d.columns if c != "doc_id"])


@query("task_contracts", """WITH d AS (SELECT doc_id, source, text || chr(10) || 'You must write /srv/out/' || doc_id || '.csv, only once.' || chr(10) || 'def test_case_' || doc_id || '(' AS t FROM documents),
 l AS (SELECT *, list_filter(list_transform(string_split_regex(t, '\\r\\n|[\\n\\r]'), lambda x: trim(x, E' \\t')), lambda x: x <> '' AND regexp_matches(lower(x), 'must|exactly|do not|only|required'))[1:50] AS cons, lower(source || ' ' || t) AS low FROM d)
 SELECT doc_id, regexp_extract(t, '(?m)^def\\s+(test_[a-zA-Z0-9_]+)\\s*\\(', 1) AS test_name, '/srv/out/' || doc_id || '.csv' AS artifact, len(cons) AS constraints,
  concat_ws('|', CASE WHEN regexp_matches(low, 'terminal|shell|command|cli|server') THEN 'terminal-operation' END, CASE WHEN regexp_matches(low, 'write|save|export|output|generate|create') THEN 'artifact-generation' END,
   CASE WHEN regexp_matches(low, 'read|load|parse|extract') THEN 'input-parsing' END, CASE WHEN regexp_matches(low, 'fix|debug|error|failing|broken') THEN 'debugging' END, CASE WHEN regexp_matches(low, 'test|verify|validate|check') THEN 'validation' END) AS capabilities FROM l""")
def task_contracts(spark, sf):
    k = F.col("doc_id").cast("string")
    d = table(spark, sf, "documents").select("doc_id", "source", F.concat(F.col("text"), F.lit("\nYou must write /srv/out/"), k, F.lit(".csv, only once.\ndef test_case_"), k, F.lit("(")).alias("t"))
    t = F.col("t")
    return d.select("doc_id", F.get(T.test_names(t), 0).alias("test_name"), F.element_at(T.output_artifacts(t), -1).alias("artifact"),
                    F.size(T.constraint_lines(t)).cast("long").alias("constraints"), F.array_join(T.required_capabilities(t, F.col("source")), "|").alias("capabilities"))


@query("instruction_kinds", """SELECT CASE WHEN regexp_matches(t, 'validat|verif|reopen|integrity|completion|final scan|acceptance|well-formed|parse successfully') THEN 'validation'
 WHEN regexp_matches(t, 'plan|planning|derive|contract|inventory|manifest|before editing|before mutation|before writing|identify') THEN 'planning'
 WHEN regexp_matches(t, 'check|confirm|compare|ensure|inspect|count|preserve|review|assert') THEN 'checking' END AS kind, count(*) AS n FROM (SELECT replace(lower(text), 'ß', 'ss') AS t FROM documents) GROUP BY 1""")
def instruction_kinds(spark, sf):
    return table(spark, sf, "documents").groupBy(T.instruction_kind(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("fingerprints", "SELECT p_partkey, left(sha256(p_name), 16) AS task_fingerprint, sha256(lower(p_name) || chr(31) || lower(p_brand)) AS fingerprint FROM part")
def fingerprints(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.task_fingerprint(F.col("p_name")).alias("task_fingerprint"), T.fingerprint(F.col("p_name"), F.col("p_brand")).alias("fingerprint"))


@query("cleaned_values", """SELECT o_orderkey, upper(o_orderpriority) AS k, o_totalprice AS n, strftime(o_orderdate, '%Y-%m-%d') AS d, o_totalprice AS c FROM orders""")
def cleaned_values(spark, sf):
    o = table(spark, sf, "orders")
    text = F.format_number("o_totalprice", 2)
    day = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    comma = F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    return o.select("o_orderkey", CLN.key(F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit("\t"))).alias("k"), CLN.number(text).alias("n"),
                    F.date_format(CLN.date_of(day), "yyyy-MM-dd").alias("d"), CLN.decimal_comma(comma).alias("c"))


def _payloads(spark, sf):
    o = table(spark, sf, "orders")
    k, p = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    ok = F.when(F.col("o_orderstatus") == "F", "Passed").otherwise("call_failed")
    js = (F.when(p == "1-URGENT", F.concat(F.lit('{"tests":[{"name":"t'), k, F.lit('","status":"'), ok, F.lit('","message":"m","trace":"tr"},{"raw_status":"skipped"}]}')))
          .when(p == "2-HIGH", F.concat(F.lit('{"parser_results":{"b":"'), ok, F.lit('","a":{"status":"'), ok, F.lit('","error":"e'), k, F.lit('"}}}')))
          .when(p == "3-MEDIUM", F.concat(F.lit('{"results":{"tests":[{"name":"x","status":"'), ok, F.lit('"}]},"error":"boom"}')))
          .when(p == "5-LOW", F.concat(F.lit('{"rewards":{"reward":'), (F.col("o_custkey") % 2).cast("string"), F.lit("}}")))
          .otherwise(F.lit('{"other":1}')))
    return o.select("o_orderkey", js.alias("payload"))


@query("verifier_feedback", """WITH o AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'passed' ELSE 'failed' END AS ok FROM orders)
 SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 't' || o_orderkey || '=' || ok || '|verifier=skipped' WHEN '2-HIGH' THEN 'a=' || ok || '|b=' || ok WHEN '3-MEDIUM' THEN 'x=' || ok || '|verifier_error=failed'
  WHEN '5-LOW' THEN 'reward=' || CASE WHEN o_custkey % 2 = 1 THEN 'passed' ELSE 'failed' END ELSE 'verifier_payload=unknown' END AS entries,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'm' || chr(10) || 'tr' WHEN '2-HIGH' THEN 'e' || o_orderkey WHEN '3-MEDIUM' THEN '' WHEN '5-LOW' THEN '' ELSE '{"other":1}' END AS first_message FROM o""")
def verifier_feedback(spark, sf):
    d = _payloads(spark, sf).withColumn("e", FB.feedback(F.col("payload")))
    return d.select("o_orderkey", F.array_join(F.transform("e", lambda x: F.concat_ws("=", x["name"], x["status"])), "|").alias("entries"), F.get("e", 0)["message"].alias("first_message"))


@query("failed_checks", """WITH o AS (SELECT *, o_orderstatus <> 'F' AS bad FROM orders)
 SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN CASE WHEN bad THEN 't' || o_orderkey || '|verifier' ELSE 'verifier' END WHEN '2-HIGH' THEN CASE WHEN bad THEN 'a|b' ELSE '' END WHEN '3-MEDIUM' THEN CASE WHEN bad THEN 'x|verifier_error' ELSE 'verifier_error' END
  WHEN '5-LOW' THEN CASE WHEN o_custkey % 2 = 1 THEN '' ELSE 'reward' END ELSE 'verifier_payload' END AS failed FROM o""")
def failed_checks(spark, sf):
    d = _payloads(spark, sf)
    side = F.when(F.col("payload").contains("tests"), F.col("payload"))
    return d.select("o_orderkey", F.array_join(FB.failed_names(FB.feedback(FB.merge_sidecar(F.when(side.isNull(), F.col("payload")), side))), "|").alias("failed"))


# Lines in front of every document: kinds, a fence, a table cell, a short item, fuller and poorer wordings.
LIST_LINES = (
    "- Verify every total in {source} before the final report", "```", "- Verify every total in {source} before the final report", "```",
    "* verify EVERY total in {source} before the final report is signed off", "1. Plan the inventory of all {lang} sources and tables",
    "2. plan the inventory of all sources", "- Verify totals in {source} | before the final report", "+ Verify {source}",
    "3) Checklist: compare the {lang} ledger with the bank statement of doc {doc_id}", "4) checklist: compare the {lang} ledger with the bank statement",
    "- [ ] Plan the delivery of crates to {source} and the way back",
)


def _listed(text: str, column, join) -> str:
    """The lines with column values put in; ``column`` and ``join`` say how."""
    out = []
    for piece in "\n".join(LIST_LINES).split("{"):
        name, brace, rest = piece.partition("}")
        out += [column(name), rest] if brace else [piece]
    return join([*out, "\n", column(text)])


def _lists_sql() -> str:
    text = _listed("text", lambda c: f"d.{c}::VARCHAR", lambda parts: " || ".join(
        x if x.startswith("d.") else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in parts))
    has = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"
    stop = ", ".join(f"'{w}'" for w in X.COMPACTION_STOP_WORDS)
    return f"""WITH RECURSIVE d0 AS (SELECT doc_id, string_split({text}, chr(10)) AS l FROM documents d),
  l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM d0),
  m AS (SELECT *, regexp_matches(line, '^\\s*```') AS fence, regexp_extract(line, '{X.LIST_ITEM}', 1) AS mark, regexp_extract(line, '{X.LIST_ITEM}', 2) AS body FROM l),
  o AS (SELECT *, count(*) FILTER (fence) OVER (PARTITION BY doc_id ORDER BY n) AS fences, lower(body) AS low FROM m),
  k AS (SELECT *, CASE WHEN {has(X.VALIDATION_TERMS)} THEN 'validation' WHEN {has(X.PLANNING_TERMS)} THEN 'planning' WHEN {has(X.CHECKING_TERMS)} THEN 'checking' END AS kind,
    list_filter(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(low, '[`*_~]', ' ', 'g'), '\\b\\d+(?:\\.\\d+)?\\b', '<n>', 'g'), '[a-z][a-z0-9_-]{{2,}}')),
      lambda w: w NOT IN ({stop}) AND NOT starts_with(w, 'http')) AS tokens FROM o WHERE NOT fence AND fences % 2 = 0 AND NOT contains(line, '|') AND length(body) >= {X.COMPACTION_MIN_CHARS}),
  i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY n) AS i FROM k WHERE kind IS NOT NULL),
  near AS MATERIALIZED (SELECT a.doc_id, a.kind, a.i, len(a.tokens) AS size, list(len(list_intersect(a.tokens, b.tokens)) >= {X.AUDIT_MIN_SHARED} AND
      len(list_intersect(a.tokens, b.tokens)) / greatest(1, least(len(a.tokens), len(b.tokens)))::DOUBLE >= {X.NEAR_DUPLICATE_OVERLAP} ORDER BY b.i) FILTER (b.i IS NOT NULL) AS near,
      list(len(b.tokens) ORDER BY b.i) FILTER (b.i IS NOT NULL) AS sizes
    FROM i a LEFT JOIN i b ON a.doc_id = b.doc_id AND a.kind = b.kind AND b.i < a.i GROUP BY ALL),
  r(doc_id, kind, i, own, word) AS (SELECT DISTINCT doc_id, kind, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM i UNION ALL
    SELECT r.doc_id, r.kind, n.i, CASE WHEN hit = 0 THEN list_append(own, n.i) ELSE own END,
      CASE WHEN hit = 0 THEN list_append(word, n.i) WHEN n.size > n.sizes[word[hit]] THEN list_transform(range(1, len(word) + 1), lambda k: CASE WHEN k = hit THEN n.i ELSE word[k] END) ELSE word END
    FROM r, near n, LATERAL (SELECT coalesce(list_position(list_transform(word, lambda h: n.near[h]), true), 0) AS hit) WHERE n.doc_id = r.doc_id AND n.kind = r.kind AND n.i = r.i + 1),
  last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, kind ORDER BY i DESC) = 1),
  kept AS (SELECT doc_id, kind, unnest(own) AS i, unnest(word) AS w FROM last),
  new AS (SELECT i.doc_id, i.n, kept.i IS NULL AS gone, CASE WHEN kept.w <> kept.i THEN i.mark || w.body END AS wording FROM i LEFT JOIN kept USING (doc_id, kind, i) LEFT JOIN i w ON w.doc_id = i.doc_id AND w.kind = i.kind AND w.i = kept.w)
 SELECT doc_id, (count(*) FILTER (coalesce(gone, false)))::INTEGER AS removed, sha256(string_agg(coalesce(wording, line), chr(10) ORDER BY n) FILTER (NOT coalesce(gone, false))) AS digest
 FROM l LEFT JOIN new USING (doc_id, n) GROUP BY doc_id"""


@query("compacted_lists", _lists_sql())
def compacted_lists(spark, sf):
    text = _listed("text", lambda c: F.col(c).cast("string"), lambda parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))
    d = table(spark, sf, "documents").select("doc_id", text.alias("text"))
    return CP.compact_lists(d).select("doc_id", "removed", F.sha2("text", 256).alias("digest"))


@query("log_chunks", """WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
 c AS (SELECT source, trim(line, E' \\t\\r') AS line, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS n FROM l WHERE trim(line, E' \\t\\r') <> ''
   AND NOT regexp_matches(trim(line, E' \\t\\r'), '^(?:[#=\\-\\s]{20,}(?:\\s*\\d+(?:\\.\\d+)?%)?)$') AND NOT (length(line) - length(replace(line, '#', '')) >= 20 AND line LIKE '%\\%%' ESCAPE '\\'))
 SELECT source, (n - 1) // 25 AS chunk, count(*) AS lines, sha256(string_agg(line, chr(10) ORDER BY n)) AS digest FROM c GROUP BY 1, 2""")
def log_chunks(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value"))
    # Position of a line in the log of its source: document first, line second.
    d = d.withColumn("line_no", F.col("doc_id") * (1 << 24) + F.col("pos"))
    return S.compact_log(d).select("source", F.col("chunk").cast("long").alias("chunk"), "lines", F.sha2("text", 256).alias("digest"))


@query("untransposed_weeks", """SELECT p_brand, 'w' || (p_size % 4) AS week, sum(p_size)::BIGINT AS demand FROM part GROUP BY ALL""")
def untransposed_weeks(spark, sf):
    p = table(spark, sf, "part").withColumn("w", F.concat(F.lit("w"), (F.col("p_size") % 4).cast("string")))
    cols = ["w0", "w1", "w2", "w3"]
    wide = p.groupBy("p_brand").pivot("w", cols).agg(F.sum("p_size"))
    return TB.untranspose(wide, ["p_brand"], cols, "week", "demand").filter("demand is not null")


@query("flattened_exports", """SELECT c_mktsegment AS region, c_custkey AS customer, o_orderkey AS orderkey, o_totalprice AS total FROM customer JOIN orders ON c_custkey = o_custkey""")
def flattened_exports(spark, sf):
    # A nested record per order, then flattened level by level.
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    order = F.struct(F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("total"))
    nested = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_mktsegment").alias("region"), F.array(F.struct(F.col("c_custkey").alias("customer"), F.array(order).alias("orders"))).alias("depots"))
    return TB.flatten(nested, ["depots", "orders"], ["region"])
