"""Queries of the training-data operators over the driver tables, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .decontaminate import contaminated
from .manifest import tamper_report
from .near_dedup import near_duplicates
from .personal_data import personal_data
from .pieces_bpe import round_trip
from .quality import quality_scores
from .secrets import secret_report
from .sharding import shard_report
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .tables import documents
from .token_counts import token_counts
from .topk import exact_top_k
from .url_filter import contract_rules, judged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"


@query("op7_near_duplicates", f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT r.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, r.doc_id = min(r.c) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id, n.n""")
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=4, percent=80)


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), any_size=True)


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op5_substring_dedup", f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM w WHERE len(w) >= 20),
t AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + 19], ' ') ORDER BY doc_id, s) AS turn FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS k FROM t WHERE turn > 1),
x AS (SELECT doc_id, list(k) AS gone FROM g GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains(gone, i) = false),
    lambda i: w[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN x ON x.doc_id = w.doc_id""")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), with_text=False)


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


def _secret_sql() -> str:
    names = _either_case("password|passwd|secret|token|api_?key")
    kinds = [
        ("assign", rf"({names})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]+", 0, 24), ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
        ("forge_token", "gh[pousr]_[A-Za-z0-9]{{36}}".replace("{{", "{").replace("}}", "}"), 0, 1),
        ("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1), ("cloud_key", "AIza[A-Za-z0-9_-]{35}", 0, 1)]
    parts = []
    for k, (kind, pattern, group, least) in enumerate(kinds):
        parts.append(f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, g, p, {least} AS least FROM (
  SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g,
    string_split_regex(t, '{pattern}') AS p FROM d) WHERE len(m) > 0""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(parts)}),
b AS (SELECT doc_id, k, kind, length(g[i]) AS n, least,
  coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s,
  length(m[i]) AS size FROM a),
c AS (SELECT doc_id, k, s, kind || ':' || s::BIGINT || ':' || (s + size)::BIGINT AS span FROM b WHERE n >= least),
e AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
  string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS every FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN e ON e.doc_id = d.doc_id"""


@query("op10_secrets", _secret_sql())
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(documents(spark, sf_dir))


@query("op2_encode_decode")
def op2_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(documents(spark, sf_dir))


@query("op8_personal_data")
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


@query("op9_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10""")
def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: CRC-32 of the bytes of a list, with the table made from its polynomial.
_CRC_TABLE = """
crc_rows AS (SELECT b, list_reduce(range(0, 9), lambda c, i: CASE WHEN i = 0 THEN b
    WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS v FROM (SELECT unnest(range(0, 256)) AS b)),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM crc_rows)"""


def _crc(octets: str) -> str:
    return (f"xor(list_reduce({octets}, lambda c, x: xor(c // 256, t[1 + xor(c % 256, x)::INTEGER]), 4294967295::BIGINT), 4294967295::BIGINT)")


_LEAF = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text"))
_LOW_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op11_dataset_manifest", f"""
WITH RECURSIVE {_CRC_TABLE.strip()},
d AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS s, sha256({_LEAF}) AS leaf, sha256({_LEAF.replace("text", _LOW_TEXT)}) AS low,
  coalesce({_crc("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} % 5 = 0, false) AS picked FROM documents, crc_table),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t(level, s, i, h, n) AS (
  SELECT 0, s, pos, leaf, count(*) OVER (PARTITION BY s) FROM leaves
  UNION ALL
  SELECT level, s, i, h, count(*) OVER (PARTITION BY s) FROM (
    SELECT level + 1 AS level, s, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM t WHERE n > 1 GROUP BY level, s, i // 16)),
subs AS MATERIALIZED (SELECT s, h, row_number() OVER (ORDER BY s) - 1 AS pos FROM t WHERE n = 1),
g(level, i, h, n) AS (
  SELECT 0, pos, h, count(*) OVER () FROM subs
  UNION ALL
  SELECT level, i, h, count(*) OVER () FROM (
    SELECT level + 1 AS level, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM g WHERE n > 1 GROUP BY level, i // 16)),
e AS MATERIALIZED (SELECT a.level, a.s, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM t a JOIN t b ON a.level = b.level AND a.s = b.s AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY ALL),
f AS MATERIALIZED (SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM g a JOIN g b ON a.level = b.level AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY ALL),
u(s, pos, level, i, h, p) AS (
  SELECT s, pos, 0, pos, CASE WHEN picked THEN low ELSE leaf END, '' FROM leaves
  UNION ALL
  SELECT u.s, u.pos, u.level + 1, u.i // 16, sha256(e.l || u.h || e.r), u.p || e.l || e.r FROM u JOIN e ON e.level = u.level AND e.s = u.s AND e.i = u.i),
v(s, pos, level, i, h, p) AS (
  SELECT u.s, u.pos, 0, subs.pos, u.h, u.p FROM (SELECT *, row_number() OVER (PARTITION BY s, pos ORDER BY level DESC) AS last FROM u) u
    JOIN subs ON subs.s = u.s WHERE u.last = 1
  UNION ALL
  SELECT v.s, v.pos, v.level + 1, v.i // 16, sha256(f.l || v.h || f.r), v.p || f.l || f.r FROM v JOIN f ON f.level = v.level AND f.i = v.i),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, pos ORDER BY level DESC) AS last FROM v) WHERE last = 1)
SELECT leaves.doc_id, leaves.leaf, subs.h AS subroot, (SELECT h FROM g WHERE n = 1) AS root, sha256(w.p) AS proof_sha256, w.h AS folded_root,
  w.h = (SELECT h FROM g WHERE n = 1) AS verified
FROM leaves JOIN w ON w.s = leaves.s AND w.pos = leaves.pos JOIN subs ON subs.s = leaves.s""")
def op11_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_report(documents(spark, sf_dir))


@query("op12_spelling_variants", f"""
WITH RECURSIVE {_CRC_TABLE.strip()},
r AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
h AS (SELECT run, {_crc("flatten(list_transform(string_split(id || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] "
                        "ELSE [192 + unicode(c)::BIGINT // 64, 128 + unicode(c)::BIGINT % 64] END))")} AS h FROM r, crc_table),
x AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word FROM h),
w AS MATERIALIZED (SELECT word, count(*) AS n FROM x WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
c AS MATERIALIZED (SELECT DISTINCT word, n, k, substring(word, 1, k - 1) || substring(word, k + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM w)),
p AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n FROM c a JOIN c b ON a.k = b.k AND a.less = b.less AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM c JOIN w ON w.word = c.less
  UNION SELECT w.word, c.word, c.n FROM c JOIN w ON w.word = c.less),
b AS (SELECT word, count(*) AS n_near, max(n) AS m FROM p GROUP BY word),
y AS (SELECT b.word, n_near, m, min(encode(p.near)) AS form FROM b JOIN p ON p.word = b.word AND p.n = b.m GROUP BY ALL),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN decode(form) END AS form,
  CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM w LEFT JOIN y ON y.word = w.word),
g(word, root) AS (SELECT word, word FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, g.root, f.n, f.n_near, f.form_n FROM f JOIN g ON g.word = f.word JOIN f z ON z.word = g.root AND z.form IS NULL""")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


@query("op13_url_filter", """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(k, rule_host, rule_path, verdict) AS (VALUES (1, 'org', '/', 'allow'), (2, 'example.org', '/es/', 'block'), (3, 'example.org', '/en/1', 'block'),
  (4, 'com', '/fr/', 'allow'), (5, 'com', '/de/', 'block')),
n AS (SELECT h.*, row_number() OVER () AS row FROM h),
b AS (SELECT row, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM n JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM n LEFT JOIN b ON b.row = n.row""")
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), contract_rules(spark))
