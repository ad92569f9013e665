"""Retrieval and clustering queries over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..operators import clustering as CL
from ..operators import retrieval as RT
from ..operators import search_index as IX
from ..session import shared_folder
from .catalog import query
from .views import table

STOP = ", ".join(f"'{w}'" for w in X.RETRIEVAL_STOP_WORDS)


def sql_tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '[a-z0-9_]+'), lambda w: w NOT IN ({STOP}))"


BM25_SQL = f"""dt AS (SELECT doc_id, {sql_tokens("text")} AS toks FROM docs),
 st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM dt),
 po AS (SELECT doc_id, any_value(len(toks)) AS dl, token, count(*) AS tf FROM (SELECT doc_id, toks, unnest(toks) AS token FROM dt) GROUP BY doc_id, token),
 dfs AS (SELECT token, count(*) AS df FROM po GROUP BY 1),
 qt AS (SELECT item_id, {sql_tokens("text")} AS toks FROM benchmark),
 qs AS (SELECT item_id, len(list_distinct(toks)) AS n_terms FROM qt WHERE len(toks) > 0),
 qk AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest(toks) AS token FROM qt) GROUP BY ALL),
 sc AS (SELECT item_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(1.0, avgdl)))) AS raw, count(*) AS matched
   FROM qk JOIN po USING (token) JOIN dfs USING (token) CROSS JOIN st GROUP BY item_id, doc_id)"""
RANK = """QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sc_, 9) DESC, record_id) <= 10"""


def _queries(spark, sf, vectors: bool):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    if vectors:
        e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"))
        q = q.join(e, "query_id", "left")
    return q


def _records(spark, sf, vectors: bool):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), "text", "lang")
    if vectors:
        e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("r_vec"))
        d = d.join(e, "record_id", "left")
    return d


def _index(spark, records):
    """A new index in the shared folder."""
    index = IX.create_index(spark, shared_folder(spark, "index"))
    IX.add_records(index, records)
    return index


@query("lexical_search", f"""WITH docs AS (SELECT * FROM documents), {BM25_SQL},
 f AS (SELECT item_id AS query_id, doc_id AS record_id, raw / (raw + 2.0) AS lex, matched / n_terms::DOUBLE AS cov, 0.25 * raw / (raw + 2.0) AS sc_ FROM sc JOIN qs USING (item_id)
   WHERE raw / (raw + 2.0) >= 0.2 AND matched / n_terms::DOUBLE >= 0.5 AND matched >= CASE WHEN n_terms <= 2 THEN 1 ELSE 2 END)
 SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sc_, 9) DESC, record_id)::INTEGER AS rank, round(sc_, 5) AS score, round(cov, 6) AS lexical_coverage, 'lexical_exact' AS match_mode
 FROM f {RANK}""")
def lexical_search(spark, sf):
    d = IX.lexical_search(_index(spark, _records(spark, sf, False)), _queries(spark, sf, False), 10)
    return d.select("query_id", "record_id", "rank", F.round("score", 5).alias("score"), F.round("lexical_coverage", 6).alias("lexical_coverage"), "match_mode")


# An index of half of the records takes the others, takes new texts for some, and gives some up: as if built from what is left.
@query("updated_search", f"""WITH docs AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' revised ' || source ELSE text END AS text FROM documents WHERE lang <> 'fr'), {BM25_SQL},
 f AS (SELECT item_id AS query_id, doc_id AS record_id, raw / (raw + 2.0) AS lex, matched / n_terms::DOUBLE AS cov, 0.25 * raw / (raw + 2.0) AS sc_ FROM sc JOIN qs USING (item_id)
   WHERE raw / (raw + 2.0) >= 0.2 AND matched / n_terms::DOUBLE >= 0.5 AND matched >= CASE WHEN n_terms <= 2 THEN 1 ELSE 2 END)
 SELECT query_id, record_id, round(sc_, 5) AS score, round(lex, 5) AS lexical_score, round(cov, 6) AS lexical_coverage FROM f {RANK}""")
def updated_search(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), "text", "lang", "source")
    index = _index(spark, d.where("record_id % 2 = 0"))
    IX.add_records(index, d.where("record_id % 2 = 1"))
    IX.add_records(index, d.where("record_id % 5 = 0").withColumn("text", F.concat("text", F.lit(" revised "), "source")))
    IX.remove_records(index, d.where("lang = 'fr'"))
    found = IX.lexical_search(IX.open_index(spark, index.folder), _queries(spark, sf, False), 10)
    return found.select("query_id", "record_id", F.round("score", 5).alias("score"), F.round("lexical_score", 5).alias("lexical_score"), F.round("lexical_coverage", 6).alias("lexical_coverage"))


@query("filtered_lexical_search", f"""WITH docs AS (SELECT * FROM documents WHERE lang = 'en'), {BM25_SQL},
 f AS (SELECT item_id AS query_id, doc_id AS record_id, 0.25 * raw / (raw + 2.0) AS sc_ FROM sc JOIN qs USING (item_id)
   WHERE raw / (raw + 2.0) >= 0.2 AND matched / n_terms::DOUBLE >= 0.5 AND matched >= CASE WHEN n_terms <= 2 THEN 1 ELSE 2 END)
 SELECT query_id, record_id, round(sc_, 5) AS score FROM f {RANK}""")
def filtered_lexical_search(spark, sf):
    d = IX.lexical_search(_index(spark, _records(spark, sf, False).filter("lang = 'en'")), _queries(spark, sf, False), 10)
    return d.select("query_id", "record_id", F.round("score", 5).alias("score"))


@query("hybrid_search", f"""WITH docs AS (SELECT * FROM documents), {BM25_SQL},
 vq AS (SELECT item_id, embedding::DOUBLE[] AS qv FROM qs LEFT JOIN embeddings ON item_id = vec_id),
 vd AS (SELECT doc_id, embedding::DOUBLE[] AS dv FROM dt LEFT JOIN embeddings ON doc_id = vec_id),
 p AS (SELECT item_id, doc_id, n_terms, coalesce(raw, 0) AS raw, coalesce(matched, 0) AS matched, list_cosine_similarity(qv, dv) AS sem
   FROM qs JOIN vq USING (item_id) CROSS JOIN vd LEFT JOIN sc USING (item_id, doc_id)),
 g AS (SELECT *, raw / (raw + 2.0) AS lex, matched / n_terms::DOUBLE AS cov, 0.25 * raw / (raw + 2.0) + coalesce(0.75 * greatest(0, sem), 0) AS sc_ FROM p),
 f AS (SELECT item_id AS query_id, doc_id AS record_id, sc_, sem, coalesce(sem >= 0.38 AND sc_ >= 0.34, false) AS hyb FROM g
   WHERE coalesce(sem >= 0.38 AND sc_ >= 0.34, false) OR (lex >= 0.2 AND cov >= 0.5 AND matched >= CASE WHEN n_terms <= 2 THEN 1 ELSE 2 END))
 SELECT query_id, record_id, round(sc_, 5) AS score, round(sem, 5) AS semantic_score, CASE WHEN hyb THEN 'hybrid' ELSE 'lexical_exact' END AS match_mode FROM f {RANK}""")
def hybrid_search(spark, sf):
    records, q = _records(spark, sf, True), _queries(spark, sf, True)
    near = RT.similar_pairs(q.select("query_id", "q_vec"), records.select("record_id", "r_vec"), X.MIN_SEMANTIC - 1e-9)
    d = IX.hybrid_search(_index(spark, records), q, records, near, 10)
    return d.select("query_id", "record_id", F.round("score", 5).alias("score"), F.round("semantic_score", 5).alias("semantic_score"), "match_mode")


@query("token_statistics", f"""WITH t AS (SELECT lang, unnest({sql_tokens("text")}) AS token FROM documents)
 SELECT lang, count(*) AS tokens, count(DISTINCT token) AS vocabulary FROM t GROUP BY 1""")
def token_statistics(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.explode(T.retrieval_tokens(F.col("text"))).alias("token"))
    return d.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("vocabulary"))


def _markdown(spark, sf):
    head = F.concat(F.lit("# Guide "), F.col("lang"), F.lit("\n"), F.col("text"), F.lit("\n## Steps "), F.col("source"), F.lit("\nvalidate "), F.col("source"),
                    F.lit(" totals\n## Steps "), F.col("source"), F.lit("\nonly "), F.col("lang"), F.lit(" totals\n# Closing\nnothing\n"))
    return table(spark, sf, "documents").select("doc_id", "source", "lang", head.alias("text"))


@query("markdown_sections", """SELECT doc_id, unnest(['guide-' || lang, 'steps-' || source, 'steps-' || source || '-2', 'closing']) AS section_id, unnest([1, 2, 2, 1]) AS level,
 unnest([false, true, true, true]) AS is_leaf, unnest([length('# Guide ' || lang || '.' || text || '.## Steps ' || source || '.validate ' || source || ' totals.## Steps ' || source || '.only ' || lang || ' totals.'),
 length('## Steps ' || source || '.validate ' || source || ' totals.'), length('## Steps ' || source || '.only ' || lang || ' totals.'), length('# Closing.nothing.')]) AS n_chars FROM documents""")
def markdown_sections(spark, sf):
    return RT.sections(_markdown(spark, sf)).select("doc_id", "section_id", "level", "is_leaf", F.length("content").cast("long").alias("n_chars"))


def _section_tokens_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in X.SECTION_STOP_WORDS)
    return f"list_filter(list_distinct(list_transform(regexp_extract_all({text}, '{X.SECTION_TOKEN}'), lambda w: lower(w))), lambda w: w NOT IN ({stop}))"


# The leaves of every document with the words that count; the question differs by document.
@query("ranked_sections", f"""WITH s AS (SELECT doc_id, unnest([1, 2, 3]) AS pos, unnest(['Steps ' || source, 'Steps ' || source, 'Closing']) AS heading,
    unnest(['steps-' || source, 'steps-' || source || '-2', 'closing']) AS section_id,
    unnest(['## Steps ' || source || ' validate ' || source || ' totals', '## Steps ' || source || ' only ' || lang || ' totals', '# Closing nothing']) AS content,
    CASE doc_id % 5 WHEN 0 THEN 'validate the totals of ' || source WHEN 1 THEN 'closing with nothing left' WHEN 2 THEN 'steps and totals only' WHEN 3 THEN 'closing ' || source ELSE 'unrelated words' END AS query FROM documents),
  t AS (SELECT doc_id, pos, section_id, 4 * len(list_intersect({_section_tokens_sql("query")}, {_section_tokens_sql("heading")})) + len(list_intersect({_section_tokens_sql("query")}, {_section_tokens_sql("content")})) AS score FROM s),
  b AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM t WHERE score > 0)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank, section_id, score FROM b WHERE score >= greatest(2, (best + 1) // 2) QUALIFY rank <= 4""")
def ranked_sections(spark, sf):
    d = _markdown(spark, sf)
    ask = F.col("doc_id") % 5
    question = (F.when(ask == 0, F.concat(F.lit("validate the totals of "), F.col("source"))).when(ask == 1, "closing with nothing left")
                .when(ask == 2, "steps and totals only").when(ask == 3, F.concat(F.lit("closing "), F.col("source"))).otherwise("unrelated words"))
    q = d.select("doc_id", question.alias("query"))
    return RT.rank_sections(RT.sections(d), q).select("doc_id", "rank", "section_id", "score")


def _vectors(spark, sf):
    """Vectors as candidates: the label is the pool, normalized like an encoder's output."""
    v = F.col("embedding")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("family-"), (F.col("label") % 3).cast("string")).alias("task_family"), F.element_at(F.array(*[F.lit(k) for k in X.CANDIDATE_KINDS]), (F.col("label") % 3 + 1).cast("int")).alias("candidate_kind"),
        F.sha2(F.col("vec_id").cast("string"), 256).alias("fingerprint"), F.transform(v, lambda x: (x / norm).cast("float")).alias("vector"), "vec_id")


# First fit in fingerprint order, one point per step: clusters with a distant member are ruled out, the lowest other number is taken.
@query("vector_clusters", """WITH RECURSIVE e AS (SELECT vec_id, label % 3 AS pool, sha256(vec_id::VARCHAR) AS fingerprint, embedding AS e,
    sqrt(list_reduce(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), lambda a, b: a + b)) AS size FROM embeddings),
  v AS MATERIALIZED (SELECT pool, fingerprint, row_number() OVER (PARTITION BY pool ORDER BY fingerprint) AS i, list_transform(e, lambda x: (x::DOUBLE / size)::FLOAT)::DOUBLE[] AS v FROM e),
  near AS MATERIALIZED (SELECT a.pool, a.i, list(list_dot_product(a.v, b.v) >= 0.75 ORDER BY b.i) FILTER (b.i IS NOT NULL) AS near FROM v a LEFT JOIN v b ON a.pool = b.pool AND b.i < a.i GROUP BY 1, 2),
  r(pool, i, placed) AS (SELECT DISTINCT pool, 0::BIGINT, []::BIGINT[] FROM v UNION ALL
    SELECT r.pool, n.i, list_append(placed, list_min(list_filter(range(1, coalesce(list_max(placed), 0) + 2),
      lambda c: list_contains(list_transform(range(1, r.i + 1), lambda j: CASE WHEN NOT n.near[j] THEN placed[j] END), c) IS NOT TRUE))) FROM r JOIN near n ON n.pool = r.pool AND n.i = r.i + 1),
  last AS (SELECT pool, placed FROM r QUALIFY row_number() OVER (PARTITION BY pool ORDER BY i DESC) = 1),
  m AS MATERIALIZED (SELECT v.pool, fingerprint, v.v, placed[v.i] AS cluster FROM v JOIN last USING (pool)),
  s AS (SELECT a.pool, a.cluster, a.fingerprint, count(*) AS members, round(coalesce(sum(list_dot_product(a.v, b.v)) FILTER (a.fingerprint <> b.fingerprint) / nullif(count(*) - 1, 0), 0), 6) AS mean
    FROM m a JOIN m b USING (pool, cluster) GROUP BY 1, 2, 3)
  SELECT 'family-' || pool AS task_family, ['recovery_candidate', 'atomic_substep', 'workflow'][pool + 1] AS candidate_kind, cluster - 1 AS cluster, members, fingerprint AS representative
  FROM s QUALIFY row_number() OVER (PARTITION BY pool, cluster ORDER BY mean DESC, fingerprint) = 1""")
def vector_clusters(spark, sf):
    placed = CL.cluster_points(_vectors(spark, sf))
    return CL.representatives(placed).select("task_family", "candidate_kind", "cluster", "members", "representative")


@query("semantic_pairs", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
 SELECT a.vec_id AS query_id, b.vec_id AS record_id FROM v a JOIN v b ON list_cosine_similarity(a.e, b.e) >= 0.38""")
def semantic_pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"))
    r = e.select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("r_vec"))
    return RT.similar_pairs(q, r, X.MIN_SEMANTIC).select("query_id", "record_id")
